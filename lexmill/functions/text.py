"""Column functions on text, JSON and ratios."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.dims import OCR_PAIRS

ANY_SPACE = "(?U)\\s"


def let(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x) with x worked out once, for lambda bodies, which have no common subexpressions."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at both ends, Unicode's included (trim() drops U+0020 only)."""
    return F.regexp_replace(c, "(?U)\\A\\s+|\\s+\\z", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)\\s+\\z", "")


def fix_ocr(c: Column, pairs: dict[str, str] | None = None) -> Column:
    """Known misreadings replaced one after the other, wherever they stand."""
    for wrong, right in (pairs or OCR_PAIRS).items():
        c = F.replace(c, F.lit(wrong), F.lit(right))
    return c


def rejoin_hyphens(c: Column) -> Column:
    """Words broken over two lines, before an ASCII lower-case letter."""
    return F.regexp_replace(c, "-\n([a-z])", "$1")


def normalize_space(c: Column) -> Column:
    """No white space at line ends, one blank line for many, none at the text's ends."""
    c = F.regexp_replace(c, "(?U)[^\\S\n]+(?=\n|\\z)", "")
    return strip(F.regexp_replace(c, "\n{3,}", "\n\n"))


def sentences(c: Column) -> Column:
    """Array of sentences: after . ! ? before a capital, quote or parenthesis, and at blank lines."""
    cut = F.split(c, "(?<=[.!?])(?U:\\s+)(?=[A-Z\\(\"])", -1)
    parts = F.flatten(F.transform(cut, lambda s: F.split(s, "\n\n", -1)))
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def words(c: Column) -> Column:
    """Runs of ASCII letters."""
    return F.regexp_extract_all(c, F.lit("[A-Za-z]+"), F.lit(0))


def ratio(part: Column, whole: Column, empty: Column | float | None = None) -> Column:
    """part / whole in one division; `empty` where whole is 0."""
    other = empty if isinstance(empty, Column) else F.lit(empty)
    return F.when(whole != 0, part.cast("double") / whole.cast("double")).otherwise(other.cast("double"))


CLASSIFICATION = (
    "strategy_name string, present boolean, confidence double, evidence_quotes array<string>, "
    "linguistic_devices array<struct<device:string,example:string,function:string>>, target_languages array<string>, "
    "topoi array<string>, notes string, error boolean, repaired boolean"
)


def parse_reply(c: Column) -> Column:
    """A model's JSON reply as a struct: as it stands, else from a fenced block, else what a truncated reply still holds.

    Null if the strategy's name or the present flag can't be recovered.
    """

    def direct(x: Column) -> Column:
        # a reply must be an object; PERMISSIVE parsing gives a struct of nulls for a broken one
        whole = F.from_json(x, CLASSIFICATION, {"mode": "PERMISSIVE"})
        return F.when(F.get_json_object(x, "$").isNotNull() & x.rlike("\\A\\s*\\{") & F.try_parse_json(x).isNotNull(), whole)

    fenced = F.regexp_extract(c, "(?s)```(?:json)?\\s*\\n?(.*?)\\n?```", 1)
    name = F.regexp_extract(c, '"strategy_name":\\s*"([^"]+)"', 1)
    present = F.regexp_extract(c, '"present":\\s*(true|false)', 1)
    confidence = F.regexp_extract(c, '"confidence":\\s*([0-9.]+)', 1)
    after = F.regexp_extract(c, '(?s)"evidence_quotes":\\s*\\[(.*)\\z', 1)
    quotes = F.filter(F.regexp_extract_all(after, F.lit('(?s)"((?:[^"\\\\]|\\\\.)*)"'), F.lit(1)), lambda q: F.length(q) > 5)
    none = F.array().cast("array<string>")
    repaired = F.struct(
        name.alias("strategy_name"),
        (present == "true").alias("present"),
        F.coalesce(confidence.try_cast("double"), F.lit(0.0)).alias("confidence"),
        F.coalesce(quotes, none).alias("evidence_quotes"),
        F.array().cast("array<struct<device:string,example:string,function:string>>").alias("linguistic_devices"),
        none.alias("target_languages"),
        F.lit(None).cast("array<string>").alias("topoi"),
        F.lit("Cut-off reply; fields read one by one.").alias("notes"),
        F.lit(None).cast("boolean").alias("error"),
        F.lit(True).alias("repaired"),
    )
    return F.coalesce(direct(c), F.when(fenced != "", direct(fenced)), F.when((name != "") & (present != ""), repaired))
