"""Text expressions: sentences from records, retrieval queries, normal form, hashes, JSON pieces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.operators.cleaning import strip

# Phrases of the record summary.
CLAIMS_PHRASES = {
    0: "no prior claims history",
    1: "one prior claim on record",
    2: "two prior claims on record",
    3: "three prior claims on record",
}
TERRITORY_PHRASES = {
    "UK": "based in the UK",
    "US": "operating in the US market",
    "EU": "domiciled in the EU",
    "APAC": "headquartered in the Asia-Pacific region",
    "LATAM": "operating across Latin America",
}
RISK_PHRASES = {
    "property": "property damage and business interruption",
    "liability": "third-party liability and legal defence costs",
    "marine": "marine cargo and hull exposures",
    "cyber": "cyber incident response and data breach liability",
    "aviation": "aviation hull and liability",
}


def _lookup(column: Column, table: dict, default: Column) -> Column:
    out = F
    for key, phrase in table.items():
        out = out.when(column == key, F.lit(phrase))
    return out.otherwise(default)


def half_even(value: Column, digits: int) -> Column:
    """A double with fixed digits and thousands separators, rounded on its exact binary value."""
    return F.format_number(value.cast("double"), digits)


def record_sentence(underwriter: str, missing: str = "nan") -> Column:
    """The three-sentence summary of a record row; fields without a phrase for it show `missing` where they have no value."""
    blank = F.lit(missing)
    limit, premium = F.col("limit").cast("double"), F.col("premium").cast("double")
    limit_text = F.when(
        limit / 1e6 >= 1, F.concat(F.lit("$"), F.regexp_replace(half_even(limit / 1e6, 1), ",", ""), F.lit("m"))
    ).otherwise(F.concat(F.lit("$"), half_even(limit, 0)))
    limit_text = F.when(limit.isNull() | F.isnan(limit), F.concat(F.lit("$"), blank)).otherwise(limit_text)
    thousands = F.when(~F.isnan(premium), F.regexp_replace(half_even(premium / 1e3, 0), ",", ""))
    premium_text = F.concat(F.lit("$"), F.coalesce(thousands, blank), F.lit("k"))
    risk, territory = F.coalesce(F.lower(strip("risk_type")), blank), F.coalesce(strip("territory"), blank)
    claims = F.col("prior_claims").cast("int")
    years = F.col("years_trading")
    claims_text = F.when(claims.isNull(), F.lit("unknown prior claims history")).otherwise(
        _lookup(claims, CLAIMS_PHRASES, F.concat(claims.cast("string"), F.lit(" prior claims on record")))
    )
    trading = (
        F.when(years.isNull(), F.lit("an entity with unknown trading history"))
        .when(years < 5, F.lit("a recently established entity"))
        .otherwise(
            F.concat(F.lit("a business with "), years.cast("int").cast("string"), F.lit(" years of trading history"))
        )
    )
    return F.concat(
        F.lit("This is a "), risk, F.lit(" record covering "), _lookup(risk, RISK_PHRASES, risk),
        F.lit(", submitted by "), F.coalesce(strip("broker"), blank), F.lit(" for a "),
        F.coalesce(strip("industry"), F.lit("an undisclosed industry")), F.lit(" account "),
        _lookup(territory, TERRITORY_PHRASES, territory), F.lit(". The insured is "), trading,
        F.lit(", with "), claims_text, F.lit(". The policy limit is "), limit_text,
        F.lit(" and the quoted premium is "), premium_text, F.lit(f", placed with {underwriter}."),
    )


def retrieval_query() -> Column:
    """Words for the similarity search; absent parts are skipped."""

    def text(name: str) -> Column:
        return F.when(F.col(name) != "", F.col(name))

    claims = F.col("prior_claims")
    shown = F.when(claims == F.floor(claims), claims.cast("long").cast("string")).otherwise(claims.cast("string"))
    parts = [
        text("risk_type"),
        F.concat(text("industry"), F.lit(" company")),
        F.concat(F.lit("in "), text("territory")),
        F.when(claims != 0, F.concat(F.lit("with "), shown, F.lit(" prior claim(s)"))),
        F.when(F.col("limit") != 0, F.concat(F.lit("limit "), half_even(F.col("limit"), 0))),
    ]
    return F.coalesce(F.nullif(F.concat_ws(" ", *parts), F.lit("")), F.lit("insurance record"))


# Fixed value: the pattern of a fenced JSON block.
FENCED_JSON = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"


def json_object(column: str | Column) -> Column:
    """The JSON object inside free text: a fenced block first, else first `{` to last `}`."""
    text = F.col(column) if isinstance(column, str) else column
    fenced = F.nullif(F.regexp_extract(text, FENCED_JSON, 1), F.lit(""))
    bare = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    found = F.coalesce(fenced, bare)
    return F.when(F.try_parse_json(found).isNotNull(), found)


def squeeze(text: str | Column) -> Column:
    """Every run of white space as one blank; a single blank is no match, so most words cost no replacement."""
    return F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"(?U)[\s&&[^ ]]\s*| \s+", " ")


def normal_form(text: str | Column) -> Column:
    """Lower case, single blanks, trimmed, without punctuation."""
    low = F.lower(F.col(text) if isinstance(text, str) else text)
    return F.regexp_replace(F.trim(squeeze(low)), r"(?U)[^\w\s]", "")


def content_hash(text: str | Column) -> Column:
    return F.sha2(normal_form(text), 256)


def _pack(pieces: Column, size: int, separator: str, overlap: int) -> Column:
    """Greedy packing of pieces into chunks; `overlap` characters' worth of pieces are carried on.

    One fold per document over its pieces with the current chunk as state; finished chunks are
    appended, so the text is copied once.
    """
    sep = len(separator)
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("done"), empty.alias("open"), F.lit(0).alias("size"))

    def total(items: Column) -> Column:
        lengths = F.aggregate(items, F.lit(0), lambda a, s: a + F.char_length(s))
        return lengths + F.greatest(F.size(items) - 1, F.lit(0)) * sep

    def step(acc: Column, piece: Column) -> Column:
        joined = acc["size"] + F.char_length(piece) + F.when(F.size(acc["open"]) > 0, sep).otherwise(0)
        full = (joined > size) & (F.size(acc["open"]) > 0)
        closed = F.array_join(acc["open"], separator)
        if overlap:
            items = acc["open"]
            n = F.size(items)
            # longest tail of pieces that is no longer than the overlap and leaves room for the piece
            keeps = F.filter(
                F.sequence(F.lit(1), n),
                lambda i: (total(F.slice(items, i + 1, n)) <= overlap)
                & (
                    (total(F.slice(items, i + 1, n)) + F.char_length(piece) + F.when(i < n, sep).otherwise(0) <= size)
                    | (i == n)
                ),
            )
            carried = F.slice(items, F.element_at(keeps, 1) + 1, n)
        else:
            carried = empty
        opened = F.concat(F.when(full, carried).otherwise(acc["open"]), F.array(piece))
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(closed))).otherwise(acc["done"]).alias("done"),
            opened.alias("open"),
            F.when(full, total(opened)).otherwise(joined).cast("int").alias("size"),
        )

    def close(acc: Column) -> Column:
        return F.when(
            F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(F.array_join(acc["open"], separator)))
        ).otherwise(acc["done"])

    return F.aggregate(pieces, start, step, close)


def split_characters(text: str | Column, size: int = 1000, overlap: int = 10, separator: str = "\n\n") -> Column:
    """Chunks of at most `size` characters cut at the separator; a longer piece stays whole."""
    column = F.col(text) if isinstance(text, str) else text
    pieces = F.filter(F.split(column, _literal(separator)), lambda p: p != "")
    chunks = _pack(pieces, size, separator, overlap)
    return F.filter(F.transform(chunks, strip), lambda c: c != "")


def _literal(separator: str) -> str:
    return "\\Q" + separator + "\\E"


def split_sentences(text: str | Column, size: int, compat: bool = False) -> Column:
    """Paragraphs packed sentence by sentence up to `size` characters.

    `compat=True` repeats the reference's habits: all text is one paragraph, every chunk but a
    restarted one begins with the separator, and an over-long first sentence leaves an empty
    chunk.
    """
    column = F.col(text) if isinstance(text, str) else text
    if compat:
        sentences = F.split(F.trim(squeeze(column)), _literal(". "))
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

        def step(acc: Column, s: Column) -> Column:
            full = F.char_length(acc["open"]) + F.char_length(s) > size
            return F.struct(
                F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
                F.when(full, s).otherwise(F.concat(acc["open"], F.lit(". "), s)).alias("open"),
            )

        return F.aggregate(sentences, start, step, lambda acc: F.concat(acc["done"], F.array(acc["open"])))
    paragraphs = F.filter(
        F.transform(F.split(column, r"\n\s*\n"), lambda p: F.trim(squeeze(p))), lambda p: p != ""
    )
    return F.flatten(
        F.transform(
            paragraphs,
            lambda p: F.when(F.char_length(p) <= size, F.array(p)).otherwise(
                _pack(F.filter(F.split(p, _literal(". ")), lambda s: s != ""), size, ". ", 0)
            ),
        )
    )
