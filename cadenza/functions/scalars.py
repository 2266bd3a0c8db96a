
from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F


def number(column: Column | str, default: float | None = None) -> Column:
    """PR-03: a double, or the default where the value is null, NaN or no number."""
    value = F.expr(f"try_cast(`{column}` AS double)") if isinstance(column, str) else column.try_cast("double")
    value = F.when(~F.isnan(value), value)
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def truthy(column: Column | str) -> Column:
    """PR-04: 1, true, yes and y in any case; anything else, null too, is false."""
    value = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("1", "true", "yes", "y"), F.lit(False))


def optional(df: DataFrame, name: str, default) -> Column:
    """PR-02: a column, or a literal where the frame lacks it."""
    return F.col(name) if name in df.columns else F.lit(default)


def text(df: DataFrame, name: str, default: str = "") -> Column:
    """A text column with null and absence as the default."""
    return F.coalesce(optional(df, name, default).cast("string"), F.lit(default))


def clip01(value: Column) -> Column:
    """FN-27."""
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def sigmoid(value: Column, bound: float = 30.0) -> Column:
    """FN-21: logistic of the value clipped to +-bound."""
    return 1 / (1 + F.exp(-F.least(F.greatest(value, F.lit(-bound)), F.lit(bound))))


def squashed_score(value: Column) -> Column:
    """FN-20: 0..1 as it is, 1..2 halved, anything else through the logistic."""
    return F.when(value.between(0, 1), value).when((value > 1) & (value <= 2), value / 2).otherwise(sigmoid(value))


# Groups of the 39 ARPAbet phones, and phones that Mandarin speakers confuse.
PHONE_GROUPS: dict[str, tuple[str, ...]] = {
    "vowel": ("AA", "AE", "AH", "AO", "AW", "AY", "EH", "ER", "EY", "IH", "IY", "OW", "OY", "UH", "UW"),
    "stop": ("B", "D", "G", "K", "P", "T"),
    "affricate": ("CH", "JH"),
    "fricative": ("DH", "F", "HH", "S", "SH", "TH", "V", "Z", "ZH"),
    "nasal": ("M", "N", "NG"),
    "liquid": ("L", "R"),
    "glide": ("W", "Y"),
    "silence": ("SIL", "SP", "SPN", ""),
}
CONFUSIONS: dict[str, tuple[str, ...]] = {
    "R": ("L",), "L": ("R",), "V": ("W", "F"), "W": ("V",), "F": ("V", "TH"), "TH": ("S", "T", "F"), "DH": ("Z", "D"), "N": ("NG",), "NG": ("N",),
    "IY": ("IH",), "IH": ("IY",), "EY": ("EH",), "EH": ("AE", "EY"), "AE": ("EH",), "UW": ("UH",), "UH": ("UW",),
}
TENSE_LAX = ("IY", "IH", "EY", "EH", "AE", "UW", "UH")


def phone(column: Column | str) -> Column:
    """FN-01, FN-43: trimmed, upper case, without stars and closing stress digits; null is ''."""
    value = F.col(column) if isinstance(column, str) else column
    value = F.upper(F.trim(F.coalesce(value.cast("string"), F.lit(""))))
    return F.regexp_replace(F.regexp_replace(value, r"\*", ""), r"[0-9]+$", "")


def arpabet(column: Column | str) -> Column:
    """FN-02, FN-40: upper case without closing digits; stars stay."""
    value = F.col(column) if isinstance(column, str) else column
    return F.regexp_replace(F.upper(F.coalesce(value.cast("string"), F.lit(""))), r"[0-9]+$", "")


def lookup(key: Column, values: Mapping[str, object], default=None) -> Column:
    """A fixed map as an expression; absent keys give the default."""
    pairs = [F.lit(x) for pair in values.items() for x in pair]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def phone_group(column: Column | str) -> Column:
    """FN-03: vowel, stop, ..., silence, or other."""
    by_phone = {p: group for group, phones in PHONE_GROUPS.items() for p in phones}
    return lookup(phone(column), by_phone, "other")


def phone_sequence(column: Column | str) -> Column:
    """FN-04, FN-41: normalised phones of a text separated by blanks or commas."""
    value = F.col(column) if isinstance(column, str) else column
    parts = F.split(F.coalesce(value, F.lit("")), r"[\s,]+")
    return F.filter(F.transform(parts, lambda x: phone(x)), lambda x: x != "")


def phone_label(column: Column | str) -> Column:
    """FN-05: 'target, perceived, code' as a struct target, perceived, error_type; a single phone is correct."""
    value = F.col(column) if isinstance(column, str) else column
    parts = F.transform(F.split(value, ","), lambda x: F.trim(x))
    code = F.lower(F.element_at(parts, -1))
    kind = F.when(code == "s", "substitution").when(code == "d", "deletion").when(code == "a", "addition").otherwise("other")
    return F.when(
        F.size(parts) >= 3, F.struct(phone(parts[0]).alias("target"), phone(parts[1]).alias("perceived"), kind.alias("error_type"))
    ).otherwise(F.struct(phone(parts[0]).alias("target"), phone(parts[0]).alias("perceived"), F.lit("correct").alias("error_type")))


def plain_text(column: Column | str) -> Column:
    """FN-06: upper case, straight quotes, only letters, digits, quotes, hyphens and single blanks."""
    value = F.col(column) if isinstance(column, str) else column
    value = F.upper(F.translate(F.coalesce(value, F.lit("")), "’‘", "''"))
    return F.trim(F.regexp_replace(F.regexp_replace(value, r"[^A-Z0-9'\s-]", " "), r"\s+", " "))


def tokens(column: Column | str) -> Column:
    """FN-07, FN-08: the words of the plain text, quotes around them stripped."""
    words = F.split(plain_text(column), " ")
    return F.filter(F.transform(words, lambda w: F.regexp_replace(w, r"^'+|'+$", "")), lambda w: w != "")


def reasons(*columns: Column | str) -> Column:
    """SE-06, SE-07, FN-44, FN-45: ordered union of ;-separated lists, without blanks and repeats."""
    lists = [F.split(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), ";") for c in columns]
    return F.array_join(F.array_distinct(F.filter(F.transform(F.concat(*lists), lambda x: F.trim(x)), lambda x: x != "")), ";")


def group_key(column: Column | str) -> Column:
    """PR-13: lower case, plural group names as singular."""
    value = F.lower(F.trim(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))))
    singular = {f"{g}s": g for g in ("liquid", "fricative", "vowel", "stop", "nasal", "affricate", "glide", "final_consonant")}
    return F.coalesce(lookup(value, singular), value)


def code_point_hash(column: Column | str, modulus: int = 29) -> Column:
    """FN-35: the sum of the code points modulo a prime, as a share of it."""
    value = F.split(F.col(column) if isinstance(column, str) else column, "")
    total = F.aggregate(F.filter(value, lambda c: c != ""), F.lit(0), lambda s, c: s + F.ascii(c))
    return (total % modulus) / F.lit(float(modulus))


def score_label(score: Column, mode: str) -> Column:
    """PR-08: a 0..2 score as three classes, or as 1 for an error in one of two senses."""
    value = score.cast("int")
    if mode == "three_class":
        return F.when(value == 2, "correct").when(value == 1, "acceptable_accent").when(value == 0, "error")
    if mode == "binary_recognition":
        return (value == 0).cast("int")
    if mode == "strict_standardness":
        return (value != 2).cast("int")
    raise ValueError(f"unknown mode {mode!r}")


def file_stem(column: Column | str) -> Column:
    """FN-34: letters, digits, dots, hyphens; others as one underscore; 80 characters."""
    value = F.col(column) if isinstance(column, str) else column
    return F.substring(F.regexp_replace(value, r"[^A-Za-z0-9._-]+", "_"), 1, 80)


def expand(words: Column, expansions: Mapping[str, Iterable[str]]) -> Column:
    """FN-10: words replaced by their expansions, each unit with the index of its word."""
    table = {k: list(v) for k, v in expansions.items()}
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))]

    def units(word: Column, i: Column) -> Column:
        found = F.try_element_at(F.create_map(*pairs), word) if pairs else F.lit(None).cast("array<string>")
        return F.transform(F.coalesce(found, F.array(word)), lambda u: F.struct(u.alias("unit"), i.alias("word_index")))

    return F.flatten(F.transform(words, units))
