"""Dictionaries for faked and pseudonymous values: own pools, or files of number and value, separated by a tab."""

from __future__ import annotations

import warnings

from pyspark.sql import SparkSession

from ..sqltext import literal

_FIRST = "Alba Bruno Clara Dario Elena Felix Greta Hugo Irene Jonas Katja Leon Marta Nils Olga Pablo Quirin Rosa Silas Tessa Ugo Vera Willem Xenia Yann Zoe".split()
_STEMS = "Alder Birk Cedar Dorn Elm Fern Grove Hazel Iris Juniper Kestrel Linden Maple North Oak Pine Quarry Ridge Stone Thorn Upton Vale Willow Yarrow".split()
_CITIES = "Ashford Brookfield Clearwater Dunmore Eastleigh Fairview Glenwood Harborough Ivybridge Kingsport Lakeside Millbrook Newhaven Oakham Pinehurst Riverton Seaford Thornbury Westbrook Yardley".split()
_COUNTRIES = "Argentina Belgium Canada Denmark Ecuador Finland Ghana Hungary Iceland Japan Kenya Latvia Mexico Norway Oman Peru Qatar Romania Senegal Thailand Uruguay Vietnam Yemen Zambia".split()
_FORMS = "Ltd Inc Group Works Partners".split()
_PHRASES = (
    "a quiet harbour under a pale sky", "seven boats leave before sunrise", "old maps show another coast", "rain writes on every window", "the baker counts the hours",
    "a bridge remembers each step", "children trade marbles for stories", "wind turns the mill again", "lanterns drift along the canal", "someone paints the door blue",
    "letters wait in a wooden box", "the orchard keeps its secrets",
)


def _check_97(digits: str) -> str:
    return f"{98 - int(digits + '00') % 97:02d}"


def _luhn(digits: str) -> str:
    total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
    return str(-total % 10)


def _iban(i: int) -> str:
    account = f"{i * 7919 % 10**8:08d}{i * 104729 % 10**10:010d}"
    return "DE" + _check_97(account + "1314") + account  # D and E count as 13 and 14


def _siret(i: int) -> str:
    body = f"{(i * 15485863 + 1234567) % 10**13:013d}"
    return body + _luhn(body)


def own_values(kind: str, n: int = 200) -> list[str]:
    """n values of a kind, by a rule."""
    stem = lambda i: _STEMS[i % len(_STEMS)] + ("" if i < len(_STEMS) else ("son", "field", "worth", "by", "ley", "man", "well", "gate")[i // len(_STEMS) % 8])
    rules = {
        "first_name": lambda i: _FIRST[i % 26] + ("" if i < 26 else "-" + _FIRST[(i // 26 + 3 * i) % 26]),
        "last_name": stem,
        "email": lambda i: f"{_FIRST[i % 26].lower()}.{stem(i).lower()}{i}@example.{('com', 'net', 'org')[i % 3]}",
        "address": lambda i: f"{i + 1} {stem(i)} Street, {_CITIES[i % 20]}",
        "city": lambda i: _CITIES[i % 20] + ("" if i < 20 else f" {('North', 'South', 'East', 'West', 'Upper', 'Lower', 'New', 'Old', 'Little')[i // 20 - 1]}"),
        "company": lambda i: f"{stem(i)} {_FORMS[i % 5]}",
        "country": lambda i: _COUNTRIES[i],
        "iban": _iban,
        "postcode": lambda i: f"{(i * 487 + 10007) % 100000:05d}",
        "siret": _siret,
        "lorem_ipsum": lambda i: " ".join((_PHRASES[(i + 5 * j) % 12] + (" again" if j == i // 12 else "")).capitalize() + "." for j in range(6)),
    }
    return [rules[kind](i) for i in range(min(n, len(_COUNTRIES)) if kind == "country" else 40 if kind == "lorem_ipsum" else n)]


KINDS = ("first_name", "last_name", "email", "address", "city", "company", "country", "iban", "postcode", "siret", "lorem_ipsum")


class Dictionaries:
    """What fake and pseudo functions draw from; empty until init() or load_csv()."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._values: dict[str, list[str]] = {}
        self.identifiers: list[tuple[str, str, str]] = []
        self.categories: list[tuple[str, bool, str]] = []

    def values(self, kind: str) -> list[str] | None:
        return self._values.get(kind) or None

    def array(self, kind: str) -> str:
        return f"array({', '.join(map(literal, self._values[kind]))})"

    def notice(self) -> str:
        warnings.warn("Anon: the anonymization extension is not initialized: call init()", stacklevel=3)
        return "CAST(NULL AS string)"

    def is_initialized(self) -> bool:
        return any(self._values.values())

    def init(self, path: str | None = "", locale_values: bool = True) -> bool | None:
        """Load own pools, or the files of a folder (name.csv for each kind). True if anything was loaded or had been."""
        if path is None:
            return None
        if self.is_initialized():
            warnings.warn("Anon: the anonymization extension is already initialized", stacklevel=2)
            return True
        if path:
            return any([self.load_csv(kind, f"{path.rstrip('/')}/{kind}.csv") for kind in KINDS])
        self._values = {kind: own_values(kind) for kind in KINDS}
        self._load_identifiers()
        return True

    load = init

    def load_csv(self, kind: str, path: str) -> bool:
        """Replace a dictionary by a file's lines of number, tab, value, in the numbers' order. False if it can't be read."""
        try:
            rows = self.spark.read.csv(path, sep="\t", schema="oid int, val string", mode="FAILFAST").orderBy("oid").collect()  # a dictionary is small and becomes a literal
        except Exception as e:  # a missing or malformed file is reported, as loading goes on with the next
            warnings.warn(f"Anon: {path} can't be loaded: {str(e).splitlines()[0]}", stacklevel=2)
            return False
        self._values[kind] = [r.val for r in rows]
        return True

    def reset(self) -> bool:
        self._values, self.identifiers, self.categories = {}, [], []
        return True

    unload = reset

    def _load_identifiers(self) -> None:
        #: Categories of identifiers, whether each is direct, and column names in two languages.
        table = {
            "last_name": (True, "last_name lastname surname family_name", "nom nom_famille patronyme"),
            "first_name": (True, "first_name firstname given_name", "prenom prenom_usuel"),
            "email": (True, "email mail email_address", "courriel adresse_courriel"),
            "phone_number": (True, "phone phone_number telephone mobile", "telephone tel portable"),
            "creditcard": (True, "creditcard credit_card card_number", "carte_bancaire numero_carte"),
            "ssn": (True, "ssn social_security_number", "nir numero_securite_sociale"),
            "iban": (True, "iban bank_account", "iban rib"),
            "address": (True, "address street", "adresse rue"),
            "account_id": (False, "employee_id customer_id account_id user_id", "identifiant matricule"),
            "birth": (False, "birth birthdate date_of_birth dob", "date_naissance naissance"),
            "zipcode": (False, "zipcode zip postcode postal_code", "code_postal cp"),
            "city": (False, "city town", "ville commune"),
            "name": (True, "name c_name s_name full_name", "nom_complet"),
            "ip": (False, "ip ip_address ip_addr", "adresse_ip"),
        }
        self.categories = [(k, direct, f"anon.fake_{k}") for k, (direct, _, _) in table.items()]
        self.identifiers = [(lang, name, k) for k, (_, en, fr) in table.items() for lang, words in (("en_US", en), ("fr_FR", fr)) for name in words.split()]
