"""Settings of an engine. Secret ones (algorithm, salt) stay out of repr() and of what masked roles see."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

#: Settings that masked roles can't see.
PRIVILEGED = ("dummy_locale", "k_anonymity_provider", "masking_policies", "restrict_to_trusted_schemas", "algorithm", "salt")


@dataclass
class EngineConf:
    dummy_locale: str = "en_US"
    k_anonymity_provider: str = "k_anonymity"
    masking_policies: list[str] = field(default_factory=list)
    privacy_by_default: bool = False
    restrict_to_trusted_schemas: bool = True
    strict_mode: bool = True
    transparent_dynamic_masking: bool = False
    static_masking: bool = True
    sourceschema: str = "public"
    maskschema: str = "mask"
    algorithm: str = field(default="sha256", repr=False)
    salt: str = field(default="", repr=False)

    def set(self, name: str, value) -> None:
        name = name.removeprefix("anon.")
        if name not in {f.name for f in fields(self)}:
            raise KeyError(f"unknown setting {name}")
        if name == "masking_policies" and isinstance(value, str):
            value = [p.strip() for p in value.split(",") if p.strip()]
        setattr(self, name, value)

    def visible(self, masked: bool) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self) if not masked or f.name not in PRIVILEGED}
