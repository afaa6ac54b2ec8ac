"""What the engine raises."""


class MaskingError(Exception):
    """Base of all errors of the engine."""


class InvalidLabel(MaskingError):
    def __init__(self, label: str | None, kind: str, detail: str = ""):
        super().__init__(f"Anon: `{label}` is not a valid label for a {kind}" + (f": {detail}" if detail else ""))
        self.detail = detail


class LabelNotSupported(MaskingError):
    pass


class InsufficientPrivilege(MaskingError):
    pass


class FeatureDisabled(MaskingError):
    pass


class UnknownObject(MaskingError):
    pass


class InvalidExpression(MaskingError):
    pass
