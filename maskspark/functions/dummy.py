"""Dummy values: generators of plausible values from small pools and templates, for seven locales.

Every generator has two forms: dummy_x() in the engine's locale and dummy_x_locale('fr_FR').
"""

from __future__ import annotations

from collections.abc import Callable

from ..errors import InvalidExpression
from ..sqltext import literal, unliteral
from .base import Context, mask_function
from .random import digits, pick
from .ranges import parse_range

LOCALES = ("ar_SA", "en_US", "fr_FR", "ja_JP", "pt_BR", "zh_CN", "zh_TW")

#: Pools that differ by locale; where a locale has none, en_US counts.
LOCAL = {
    "en_US": {
        "first_name": "Avery Blake Casey Drew Emery Finley Harper Jordan Kendall Logan Morgan Parker",
        "last_name": "Abbott Barker Carver Dalton Emmett Fletcher Garner Holden Ingram Keller Lawson Mercer",
        "title": "Mr. Mrs. Ms. Dr. Prof.",
        "suffix": "Jr. Sr. II III IV",
        "word": "amber breeze canyon delta ember forest garden harbor island jungle lantern meadow",
        "city_prefix": "North South East West New Lake Port",
        "city_suffix": "town ville burgh port side haven view",
        "street_suffix": "Street Avenue Road Lane Drive Court Way",
        "state_name": "Alabama Colorado Florida Georgia Kansas Maine Nevada Oregon Texas Vermont",
        "state_abbr": "AL CO FL GA KS ME NV OR TX VT",
        "company_suffix": "Inc LLC Group Ltd Partners",
        "color": "amber azure crimson emerald indigo ivory magenta olive scarlet teal",
        "profession": "accountant baker carpenter dentist editor farmer gardener janitor librarian nurse",
        "industry": "Agriculture Banking Construction Education Energy Forestry Insurance Mining Retail Transport",
    },
    "fr_FR": {
        "first_name": "Adèle Benoît Chloé Didier Éloïse Fabien Gaëlle Hervé Inès Joël Léa Maël",
        "last_name": "Aubert Bérard Chevalier Delmas Fabre Guérin Héraud Lefèvre Marchand Noël Périer Rivière",
        "title": "M. Mme Mlle Dr Pr",
        "word": "abeille brume clairière dune étoile forêt galet herbe île lumière",
        "city_prefix": "Saint- Grand- Petit- Vieux- Mont-",
        "city_suffix": "-sur-Mer -les-Bains -la-Forêt -le-Vieux",
        "street_suffix": "rue avenue chemin impasse allée quai",
        "state_name": "Auvergne Bretagne Corse Normandie Occitanie Provence",
        "state_abbr": "ARA BRE COR NOR OCC PAC",
        "company_suffix": "SA SARL SAS EURL",
        "color": "ambre azur carmin émeraude indigo ivoire olive écarlate",
        "profession": "boulanger charpentier dentiste éditeur fermier infirmier jardinier notaire",
    },
    "ja_JP": {
        "first_name": "葵 大翔 陽菜 蓮 結衣 湊 凛 樹 美咲 翼",
        "last_name": "青木 石田 上野 岡本 加藤 木村 小川 坂本 高橋 中川",
        "title": "様 先生 さん 氏",
        "suffix": "二世 三世",
        "word": "海 風 山 川 花 森 星 月 空 雪",
        "city_prefix": "北 南 東 西 新",
        "city_suffix": "市 町 村 区",
        "street_suffix": "通り 丁目 番地",
        "state_name": "北海道 青森県 東京都 大阪府 京都府 沖縄県",
        "state_abbr": "北 青 東 阪 京 沖",
        "company_suffix": "株式会社 有限会社 合同会社",
        "color": "赤 青 緑 黄 紫 白 黒",
        "profession": "教師 医師 農家 漁師 大工 画家",
    },
    "zh_CN": {
        "first_name": "伟 芳 娜 敏 静 磊 洋 勇 艳 杰",
        "last_name": "王 李 张 刘 陈 杨 赵 黄 周 吴",
        "title": "先生 女士 博士 教授",
        "word": "山 水 云 风 雨 花 鸟 鱼 石 树",
        "city_prefix": "北 南 东 西 新",
        "city_suffix": "市 县 镇 区",
        "street_suffix": "路 街 巷 大道",
        "state_name": "广东 江苏 浙江 四川 云南 山东",
        "state_abbr": "粤 苏 浙 川 云 鲁",
        "company_suffix": "有限公司 集团 股份公司",
        "color": "红 蓝 绿 黄 紫 白 黑",
    },
    "zh_TW": {
        "first_name": "雅婷 志豪 淑芬 俊傑 怡君 家豪 美玲 建宏",
        "last_name": "陳 林 黃 張 李 王 吳 劉",
        "title": "先生 女士 博士 教授",
        "word": "山 水 雲 風 雨 花 鳥 魚 石 樹",
        "city_prefix": "北 南 東 西 新",
        "city_suffix": "市 縣 鎮 區",
        "street_suffix": "路 街 巷 大道",
        "state_name": "臺北 臺中 臺南 高雄 花蓮",
        "state_abbr": "北 中 南 高 花",
        "company_suffix": "有限公司 集團 股份公司",
        "color": "紅 藍 綠 黃 紫 白 黑",
    },
    "pt_BR": {
        "first_name": "Ana Breno Cecília Davi Estêvão Flávia Gonçalo Heitor Inês João",
        "last_name": "Almeida Barbosa Cardoso Duarte Esteves Figueiredo Guimarães Lemos Moraes Nóbrega",
        "title": "Sr. Sra. Dr. Dra.",
        "word": "areia brisa canto duna estrela folha garça ilha jardim luar",
        "city_prefix": "São Santa Novo Porto",
        "city_suffix": "lândia ópolis zinho mar",
        "street_suffix": "Rua Avenida Travessa Alameda Praça",
        "state_name": "Acre Bahia Ceará Goiás Pará Paraná",
        "state_abbr": "AC BA CE GO PA PR",
        "company_suffix": "Ltda S.A. ME EIRELI",
    },
    "ar_SA": {
        "first_name": "أحمد فاطمة خالد مريم سعيد ليلى يوسف نورة",
        "last_name": "العتيبي الحربي القحطاني الشمري الغامدي الزهراني",
        "title": "السيد السيدة الدكتور",
        "word": "بحر جبل نهر قمر نجم شمس ورد شجر",
        "city_prefix": "شمال جنوب شرق غرب",
        "city_suffix": "آباد مدينة قرية",
        "street_suffix": "شارع طريق ممر",
        "state_name": "الرياض مكة عسير تبوك جازان",
        "state_abbr": "ر م ع ت ج",
        "company_suffix": "شركة مؤسسة مجموعة",
    },
}

#: Pools that all locales share.
SHARED = {
    "country_name": "Austria Brazil Canada Denmark Egypt Finland Greece Hungary Iceland Japan",
    "country_code": "AT BR CA DK EG FI GR HU IS JP",
    "timezone": "Africa/Cairo America/Lima Asia/Tokyo Europe/Oslo Europe/Paris Pacific/Fiji",
    "secondary_address_type": "Apt. Suite Floor Unit",
    "buzzword": "adaptive balanced compatible distributed ergonomic focused",
    "buzzword_middle": "analytic bifurcated dynamic global modular scalable",
    "buzzword_tail": "alliance benchmark framework hierarchy interface toolset",
    "bs_verb": "deploy engage foster harness iterate leverage streamline",
    "bs_adj": "agile compelling efficient frictionless granular holistic",
    "bs_noun": "channels deliverables ecosystems initiatives networks platforms",
    "currency_code": "AUD BRL CAD CHF EUR GBP JPY NOK SEK USD",
    "currency_name": "dollar euro franc krona peso pound real rupee yen",
    "currency_symbol": "$ € £ ¥ kr R$",
    "file_extension": "csv doc gif html jpg json pdf png txt xml",
    "rfc_status_code": "100 101 200 201 204 301 302 304 400 401 403 404 409 410 418 500 502 503",
    "valid_statux_code": "200 201 202 204 301 302 400 401 403 404 500 503",
    "free_email_provider": "mail.example post.example inbox.example",
    "domain_suffix": "com net org info biz",
    "browser": "Firefox/120.0 Chrome/119.0 Safari/605.1",
    "platform": "X11;Linux Windows_NT Macintosh",
    "ascii_word": "amber breeze canyon delta ember forest garden harbor island jungle",
    "ascii_name": "avery blake casey drew emery finley harper jordan",
}


def pool(name: str, locale: str) -> str:
    return pick((LOCAL[locale].get(name) or LOCAL["en_US"].get(name) or SHARED[name]).split())


def number(low: int, high: int) -> str:
    return f"CAST(CAST({low} + floor(rand() * {high - low + 1}) AS int) AS string)"


def letters(n: int) -> str:
    return "concat(" + ", ".join("char(65 + CAST(floor(rand() * 26) AS int))" for _ in range(n)) + ")"


def joined(*parts: str) -> str:
    return f"concat({', '.join(parts)})"


def hexes(n: int) -> str:
    return f"lower(lpad(hex(CAST(floor(rand() * {16**n}D) AS bigint)), {n}, '0'))"


def with_check(body: str, weights: str, finish: str) -> str:
    """body (digits) and a check digit: a weighted sum of the digits, put through finish, where s stands for the sum."""
    total = f"aggregate(transform(split(b, ''), (d, i) -> CAST(d AS int) * {weights}), 0, (a, x) -> a + x)"
    return f"element_at(transform(array({body}), b -> concat(b, element_at(transform(array({total}), s -> {finish}), 1))), 1)"


def luhn(body: str, doubled: int) -> str:
    """body and its Luhn digit; every second digit counts double, from place doubled (0 or 1)."""
    value = f"CAST(d AS int) * (CASE WHEN i % 2 = {doubled} THEN 2 ELSE 1 END)"
    total = f"aggregate(transform(split(b, ''), (d, i) -> {value} div 10 + ({value}) % 10), 0L, (a, x) -> a + x)"
    return f"element_at(transform(array({body}), b -> concat(b, CAST(pmod(-{total}, 10) AS string))), 1)"


def isin(body: str) -> str:
    """Letters count as their two-digit numbers; then Luhn from the right."""
    spelled = "array_join(transform(split(b, ''), c -> CASE WHEN c RLIKE '[0-9]' THEN c ELSE CAST(ascii(c) - 55 AS string) END), '')"
    value = "CAST(d AS int) * (CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END)"
    total = f"aggregate(transform(split(reverse({spelled}), ''), (d, i) -> {value} div 10 + ({value}) % 10), 0L, (a, x) -> a + x)"
    return f"element_at(transform(array({body}), b -> concat(b, CAST(pmod(-{total}, 10) AS string))), 1)"


def uuid_from(digest: str, version: int) -> str:
    """A UUID of a hexadecimal digest's first 32 digits, with version and variant in place."""
    return f"element_at(transform(array({digest}), h -> concat(substring(h, 1, 8), '-', substring(h, 9, 4), '-{version}', substring(h, 14, 3), '-', element_at(array('8','9','a','b'), 1 + CAST(conv(substring(h, 17, 1), 16, 10) AS int) % 4), substring(h, 18, 3), '-', substring(h, 21, 12))), 1)"


ISBN10 = "CASE WHEN pmod(-s, 11) = 10 THEN 'X' ELSE CAST(pmod(-s, 11) AS string) END"
SPACE, DASH, DOT, SLASH, AT, COMMA = (literal(c) for c in (" ", "-", ".", "/", "@", ", "))
_MANY = lambda f, n, sep: "concat_ws(" + ", ".join([literal(sep), *(f() for _ in range(n))]) + ")"
_IPV4 = lambda loc: _MANY(lambda: number(1, 254), 4, ".")
_IPV6 = lambda loc: _MANY(lambda: hexes(4), 8, ":")
_RGB = lambda: _MANY(lambda: number(0, 255), 3, ", ")
_HSL = lambda: joined(number(0, 360), COMMA, number(0, 100), "'%, '", number(0, 100), "'%'")
_ALPHA = "CAST(round(rand(), 2) AS string)"
_NAME = lambda loc: joined(pool("first_name", loc), SPACE, pool("last_name", loc)) if loc not in ("ja_JP", "zh_CN", "zh_TW") else joined(pool("last_name", loc), pool("first_name", loc))
_CITY = lambda loc: joined(pool("city_prefix", loc), pool("last_name", loc), pool("city_suffix", loc))
_FILE = lambda loc: joined(pool("ascii_word", loc), DOT, pool("file_extension", loc))
_DIR = lambda loc: joined(SLASH, pool("ascii_word", loc), SLASH, pool("ascii_word", loc))
_USER = lambda loc: joined(pool("ascii_name", loc), number(1, 999))
_FORMATS = {"en_US": ("#####", "^##-^##-####", "^##-^##-####"), "fr_FR": ("#####", "01 ## ## ## ##", "06 ## ## ## ##"), "ja_JP": ("###-####", "03-####-####", "090-####-####"), "pt_BR": ("#####-###", "(^#) ####-####", "(^#) 9####-####"), "zh_CN": ("######", "010-########", "13#########"), "zh_TW": ("#####", "02-####-####", "09##-###-###"), "ar_SA": ("#####", "011-#######", "05########")}

_POOLED = "city_prefix city_suffix country_name country_code street_suffix timezone state_name state_abbr secondary_address_type color company_suffix buzzword buzzword_middle buzzword_tail bs_verb bs_adj bs_noun profession industry currency_code currency_name currency_symbol file_extension rfc_status_code valid_statux_code free_email_provider domain_suffix word first_name last_name title suffix".split()

GENERATORS: dict[str, Callable[[str], str]] = {name: (lambda loc, name=name: pool(name, loc)) for name in _POOLED} | {
    "valid_status_code": lambda loc: pool("valid_statux_code", loc),
    "city_name": _CITY,
    "street_name": lambda loc: joined(pool("last_name", loc), SPACE, pool("street_suffix", loc)),
    "secondary_address": lambda loc: joined(pool("secondary_address_type", loc), SPACE, number(1, 999)),
    "zip_code": lambda loc: digits(_FORMATS[loc][0]),
    "post_code": lambda loc: digits(_FORMATS[loc][0]),
    "building_number": lambda loc: number(1, 9999),
    "latitude": lambda loc: "CAST(round(rand() * 180 - 90, 6) AS string)",
    "longitude": lambda loc: "CAST(round(rand() * 360 - 180, 6) AS string)",
    "isbn": lambda loc: with_check(digits("#########"), "(10 - i)", ISBN10),
    "isbn13": lambda loc: with_check(digits("978#########"), "(CASE WHEN i % 2 = 0 THEN 1 ELSE 3 END)", "CAST(pmod(-s, 10) AS string)"),
    "hex_color": lambda loc: joined("'#'", f"upper({hexes(6)})"),
    "rgb_color": lambda loc: joined("'rgb('", _RGB(), "')'"),
    "rgba_color": lambda loc: joined("'rgba('", _RGB(), COMMA, _ALPHA, "')'"),
    "hsl_color": lambda loc: joined("'hsl('", _HSL(), "')'"),
    "hsla_color": lambda loc: joined("'hsla('", _HSL(), COMMA, _ALPHA, "')'"),
    "company_name": lambda loc: joined(pool("last_name", loc), SPACE, pool("company_suffix", loc)),
    "catchphrase": lambda loc: joined(pool("buzzword", loc), SPACE, pool("buzzword_middle", loc), SPACE, pool("buzzword_tail", loc)),
    "bs": lambda loc: joined(pool("bs_verb", loc), SPACE, pool("bs_adj", loc), SPACE, pool("bs_noun", loc)),
    "credit_card_number": lambda loc: luhn(digits("4##############"), 0),
    "file_path": lambda loc: joined(_DIR(loc), SLASH, _FILE(loc)),
    "file_name": _FILE,
    "dir_path": _DIR,
    "bic": lambda loc: joined(letters(4), pool("country_code", loc), letters(2)),
    "isin": lambda loc: isin(joined(pool("country_code", loc), digits("#########"))),
    "free_email": lambda loc: joined(_USER(loc), AT, pool("free_email_provider", loc)),
    "safe_email": lambda loc: joined(_USER(loc), "'@example.'", pick(["com", "net", "org"])),
    "username": _USER,
    "ipv4": _IPV4,
    "ipv6": _IPV6,
    "ip": lambda loc: f"CASE WHEN rand() < 0.5 THEN {_IPV4(loc)} ELSE {_IPV6(loc)} END",
    "mac_address": lambda loc: _MANY(lambda: f"upper({hexes(2)})", 6, ":"),
    "user_agent": lambda loc: joined("'Mozilla/5.0 ('", pool("platform", loc), "') '", pool("browser", loc)),
    "name": _NAME,
    "name_with_title": lambda loc: joined(pool("title", loc), SPACE, _NAME(loc)),
    "phone_number": lambda loc: digits(_FORMATS[loc][1]),
    "cell_number": lambda loc: digits(_FORMATS[loc][2]),
}

#: French forms alone.
FRENCH: dict[str, Callable[[], str]] = {
    "health_insurance_code": lambda: f"element_at(transform(array({digits('^#########0##')}), b -> concat(b, lpad(CAST(97 - CAST(b AS bigint) % 97 AS string), 2, '0'))), 1)",
    "licence_plate": lambda: joined(letters(2), DASH, digits("###"), DASH, letters(2)),
}
#: Forms without a locale.
PLAIN: dict[str, Callable[[], str]] = {
    "uuidv1": lambda: joined(hexes(8), DASH, hexes(4), "'-1'", hexes(3), DASH, pick(["8", "9", "a", "b"]), hexes(3), DASH, hexes(12)),
    "uuidv3": lambda: uuid_from("md5(CAST(rand() AS string))", 3),
    "uuidv4": lambda: "uuid()",
    "uuidv5": lambda: uuid_from("sha1(CAST(rand() AS string))", 5),
}


def checked(locale: str | None, generator: str, known=LOCALES) -> str:
    if locale not in known:
        raise InvalidExpression(f"Anon: {locale} is not a supported locale for {generator}")
    return locale


def _words(locale: str, length: str) -> str:
    b = parse_range(length, "int4range")
    if b.lower is None or b.upper is None:
        raise InvalidExpression("the range of lengths must have bounds")
    values = (LOCAL[locale].get("word") or LOCAL["en_US"]["word"]).split()
    many = f"array_repeat(shuffle(array({', '.join(map(literal, values))})), CAST(1 + CAST({b.upper} AS int) div {len(values)} AS int))"
    return f"array_join(slice(flatten({many}), 1, CAST({b.lower} + floor(rand() * ({b.upper} - {b.lower})) AS int)), ' ')"


def _register() -> None:
    for name, build in GENERATORS.items():
        mask_function(f"dummy_{name}", deterministic=False)(lambda ctx, build=build, name=name: build(checked(ctx.conf.dummy_locale, name)))
        mask_function(f"dummy_{name}_locale", args=(1, 1), deterministic=False)(lambda ctx, loc, build=build, name=name: build(checked(unliteral(loc), name)))
    for name, build in (FRENCH | PLAIN).items():
        mask_function(f"dummy_{name}", deterministic=False)(lambda ctx, build=build: build())
    others = tuple(x for x in LOCALES if x != "ar_SA")
    mask_function("dummy_words", args=(1, 1), deterministic=False)(lambda ctx, n: _words(checked(ctx.conf.dummy_locale, "words", others), n))
    mask_function("dummy_words_locale", args=(2, 2), deterministic=False)(lambda ctx, loc, n: _words(checked(unliteral(loc), "words", others), n))


_register()
