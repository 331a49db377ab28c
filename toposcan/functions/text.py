"""Column expressions over names and short texts."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

# Letters whose ASCII form has more than one character.
LIGATURES = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ĳ": "ij"}
# Single letters without a canonical decomposition.
PLAIN = {"ø": "o", "đ": "d", "ð": "d", "ł": "l", "ħ": "h", "ı": "i", "ŧ": "t", "ŋ": "n", "ĸ": "k"}
# Typographic marks that have an ASCII twin.
MARKS = {"–": "-", "—": "-", "‐": "-", "‑": "-", "’": "'", "‘": "'"}


def _accent_table() -> tuple[str, str]:
    """Lower-case Latin letters with marks and their base letters, by Unicode decomposition."""
    src, dst = [], []
    for code in list(range(0x00E0, 0x0250)) + list(range(0x1E00, 0x1F00)):
        ch = chr(code)
        base = unicodedata.normalize("NFD", ch)[0]
        if ch.islower() and base != ch and base.isascii():
            src.append(ch)
            dst.append(base)
    for table in (PLAIN, MARKS):
        src += list(table)
        dst += list(table.values())
    return "".join(src), "".join(dst)


ACCENTED, BASE = _accent_table()

# Toponym classes, tried in this order.
TOPONYM_CLASSES = [
    ("waterway", ["waterway:", "rio", "córrego", "igarapé"]),
    ("natural", ["natural:", "floresta", "mata", "campo"]),
    ("place", ["place:", "cidade", "vila", "povoado"]),
    ("highway", ["highway:", "estrada", "rua", "avenida", "travessa"]),
    ("landuse", ["landuse:", "fazenda", "sítio", "área"]),
    ("man_made", ["man_made:", "torre", "ponte", "obra"]),
]
# Seed words and feature types of the water flag.
WATER_SEEDS = ["rio", "igarape", "lago", "parana", "cachoeira", "corrego", "lagoa", "canal", "baia", "represa"]
WATER_TYPES = ["river", "stream", "lake", "channel", "waterfall"]
# Latin forms of Greek and Cyrillic letters, one letter each ...
OTHER_PLAIN = {
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p",
    "ρ": "r", "ς": "s", "σ": "s", "τ": "t", "υ": "u", "ω": "o", "ά": "a", "έ": "e", "ή": "e", "ί": "i", "ό": "o", "ύ": "u", "ώ": "o", "ϊ": "i", "ϋ": "u", "ΐ": "i", "ΰ": "u",
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "з": "z", "и": "i", "й": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r",
    "с": "s", "т": "t", "у": "u", "ф": "f", "ъ": '"', "ы": "y", "ь": "'", "э": "e", "і": "i", "ј": "j", "ѝ": "i", "ў": "u",
}
# Fixed values: ... and more than one.
OTHER_LIGATURES = {
    "θ": "th", "φ": "ph", "χ": "kh", "ψ": "ps", "ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "iu", "я": "ia", "ё": "io", "ѐ": "ie",
    "є": "ie", "ї": "yi", "ђ": "dj", "ѓ": "gj", "ѕ": "dz", "љ": "lj", "њ": "nj", "ћ": "ts", "ќ": "kj", "џ": "dzh",
}
# Words that mark a meaning as water-related.
WATER_MEANING_JA = ["水", "川", "湖", "沼", "池", "湘", "海", "浜", "港", "汰", "水路", "河", "河口", "湖沼", "湖水",
                    "流", "渓", "港湾"]
WATER_MEANING_EN = ["water", "river", "stream", "lake", "pond", "swamp", "marsh", "creek", "channel", "bay",
                    "harbor", "lagoon", "wetland", "estuary", "delta", "mouth"]
# Words that are not names in a tag.
NON_NAMES = ["yes", "no", "true", "false"]
# Columns and tag keys tried for a name, in this order.
NAME_COLS = ["name", "alt_name", "old_name", "loc_name"]
ALT_NAME_COLS = ["ref", "addr:street", "addr:city", "official_name", "short_name", "local_name"]
TAG_NAME_KEYS = ["name", "name:ja", "name:pt", "name:en", "alt_name", "old_name", "loc_name", "ref"]


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def contains_any(col: Column, words: Sequence[str]) -> Column:
    return any_of([col.contains(w) for w in words])


def strip_accents(col: Column) -> Column:
    """ASCII form of lower-case Latin text; Greek and Cyrillic letters get their Latin forms, a soft or hard sign an apostrophe or quote."""
    def replaced(out: Column, table: dict[str, str]) -> Column:
        for letter, plain in table.items():
            out = F.replace(out, F.lit(letter), F.lit(plain))
        return out

    latin = replaced(F.translate(col, ACCENTED, BASE), LIGATURES)
    other = replaced(F.translate(latin, "".join(OTHER_PLAIN), "".join(OTHER_PLAIN.values())), OTHER_LIGATURES)
    return F.when(col.rlike("[\\u0370-\\u045f]"), other).otherwise(latin)


def normalize_name(col: Column) -> Column:
    """Lower case, no accents, only ``[a-z0-9 -]``, single spaces; null becomes ''."""
    ascii_text = strip_accents(F.lower(col))
    kept = F.regexp_replace(ascii_text, r"[^a-z0-9\s-]", " ")
    return F.coalesce(F.trim(F.regexp_replace(kept, r"\s+", " ")), F.lit(""))


def simple_root(col: Column) -> Column:
    """One of rio, igarape, lago, agua by substring of the lower-case name."""
    low = F.lower(col)
    return (
        F.when(low.contains("rio"), "rio")
        .when(low.contains("igarape") | low.contains("igarapé"), "igarape")
        .when(low.contains("lago"), "lago")
        .otherwise("agua")
    )


def underscored(col: Column) -> Column:
    return F.replace(F.lower(col), F.lit(" "), F.lit("_"))


def toponym_category(col: Column) -> Column:
    """Toponym class by keyword; the first class in the list wins."""
    low = F.lower(col)
    head, *rest = TOPONYM_CLASSES
    out = F.when(contains_any(low, head[1]), head[0])
    for name, words in rest:
        out = out.when(contains_any(low, words), name)
    return out.otherwise("other")


def is_water_name(name: Column, feature_type: Column, seeds: Sequence[str] = tuple(WATER_SEEDS)) -> Column:
    return F.coalesce(contains_any(F.lower(name), seeds), F.lit(False)) | F.coalesce(
        feature_type.isin(WATER_TYPES), F.lit(False)
    )


def is_water_meaning(ja: Column, en: Column) -> Column:
    return contains_any(F.lower(F.coalesce(ja, F.lit(""))), WATER_MEANING_JA) | contains_any(
        F.lower(F.coalesce(en, F.lit(""))), WATER_MEANING_EN
    )


def best_name(tags: Column | None, present: Sequence[str]) -> Column:
    """Best available name of a feature, null when there is none.

    ``present`` lists the name columns the table has. Order: the name columns,
    the alternative columns, then the keys of the tag map.
    """
    tries = [F.nullif(F.col(f"`{c}`"), F.lit("")) for c in NAME_COLS if c in present]
    for c in ALT_NAME_COLS:
        if c not in present:
            continue
        value = F.trim(F.col(f"`{c}`"))
        good = F.length(value) > 1
        if c == "ref":
            good = good & (F.length(value) <= 15) & ~F.lower(value).isin(NON_NAMES)
        tries.append(F.when(good, value))
    if tags is not None:
        for key in TAG_NAME_KEYS:
            value = F.trim(F.element_at(tags, key))
            tries.append(F.when((F.length(value) > 1) & ~F.lower(value).isin(NON_NAMES), value))
    return F.coalesce(*tries)


def vocabulary_pattern(tokens: Sequence[str]) -> str:
    """One alternation over distinct tokens, whole words, any case; ``(?U)`` makes the borders Unicode."""
    return r"(?iU)\b(" + "|".join(dict.fromkeys(tokens)) + r")\b"


def matched_categories(columns: Sequence[Column], patterns: dict[str, str]) -> Column:
    """Array of the categories whose pattern matches any of the name columns, in dictionary order."""
    tagged = []
    for category, pattern in patterns.items():
        hit = any_of([F.coalesce(c.rlike(pattern), F.lit(False)) for c in columns])
        tagged.append(F.when(hit, F.lit(category)))
    return F.filter(F.array(*tagged), lambda c: c.isNotNull())


def words(col: Column) -> Column:
    """White-space separated lower-case words, empty ones removed."""
    return F.filter(F.split(F.lower(col), r"\s+"), lambda w: w != "")


def first_word(col: Column) -> Column:
    return F.element_at(F.split(F.lower(F.trim(col)), r"\s+"), 1)


def numeric_change(col: Column) -> Column:
    """First signed number in an effect text, 0 when there is none."""
    cleaned = F.regexp_replace(F.trim(col), r"[+%]", "")
    return F.coalesce(F.regexp_extract(cleaned, r"(-?\d+\.?\d*)", 1).try_cast("double"), F.lit(0.0))
