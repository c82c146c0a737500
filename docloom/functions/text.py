"""Scalar text functions as columns; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERY_CHARS = 500
SPARSE_VOCABULARY_DIGITS = 6  # 16 ** 6 = 2 ** 24 places
CHARS_PER_TOKEN = 4
LEAST_TOKEN = 4

# The word lists and marker forms that decide results.
COMPARISON = r"(?i)\b(bandingkan|dibandingkan|perbedaan|dibanding|perbandingan)\b"
QUESTION = r"(?i)\b(apa|bagaimana|siapa|mengapa|kapan|berapa|kenapa)\b"
ORDINALS = "KESATU KEDUA KETIGA KEEMPAT KELIMA KEENAM KETUJUH KEDELAPAN KESEMBILAN KESEPULUH".split()
MARKERS = [
    (r"^\((\d+)\)", "DECIMAL_PAREN_FULL"),
    (r"^(\d+)\)", "DECIMAL_PAREN_CLOSE"),
    (r"^(\d+)\.", "DECIMAL_DOT"),
    (r"^\(([a-z])\)", "LETTER_PAREN_FULL"),
    (r"^([a-z])\)", "LETTER_PAREN_CLOSE"),
    (rf"^({'|'.join(ORDINALS)})\b", "ORDINAL_WORD"),
    (r"^([IVXLCDM]+)\.", "ROMAN_UPPER_DOT"),
    (r"^([ivxlcdm]+)\.", "ROMAN_LOWER_DOT"),
    (r"^([A-Z])\.", "LETTER_UPPER_DOT"),
    (r"^([a-z])\.", "LETTER_DOT"),
]
DELIMITER_LINE = r"(?m)^[=\-]{3,}\s*$"
HEADER_LINE = r"(?im)^\s*(SOURCE\s+S\d+|SYSTEM|ASSISTANT|USER QUERY|CONVERSATION CONTEXT|UNTRUSTED EVIDENCE|REMINDER)\s*:?\s*$"
REFERENCE = (
    r"(?i)\bpasal\s+\d+[a-z]?\b|\bayat\s+\(?\d+\)?|\bhuruf\s+[a-z]\b|\bbab\s+[ivxlcdm]+\b|\b(?:angka|butir|poin|bagian)\s+\d+[a-z]?\b"
    rf"|\blampiran\s+(?:[ivxlcdm]+|\d+)\b|\b(?:{'|'.join(ORDINALS)})\b"
)
LOCK_FILE = r"(^|/)~\$|\.tmp$"
MIME = {".pdf": "application/pdf", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document"}
COST_PER_1K = {"FAST": "0.000500", "STRONG": "0.010000"}
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def normalize_query(text: Column) -> Column:
    """Lower case, white space collapsed and trimmed, the first ``QUERY_CHARS`` characters."""
    return F.substring(F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " ")), 1, QUERY_CHARS)


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def feature_hash(token: Column) -> Column:
    """A token's place among 2 ** 24: the last digits of its SHA-256."""
    return F.conv(F.right(F.sha2(token, 256), F.lit(SPARSE_VOCABULARY_DIGITS)), 16, 10).cast("long")


def estimate_tokens(text: Column) -> Column:
    """Zero for an empty text, else a quarter of its characters, at least one."""
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / CHARS_PER_TOKEN))).cast("long")


def significant_tokens(text: Column) -> Column:
    """The distinct tokens of ``LEAST_TOKEN`` or more characters."""
    return F.array_distinct(F.filter(tokens(text), lambda t: F.length(t) >= LEAST_TOKEN))


def sanitize_filename(path: Column) -> Column:
    """The last part of a path with unsafe characters replaced; "file" if nothing is left."""
    name = F.element_at(F.split(path, r"[/\\]"), -1)
    return F.coalesce(F.nullif(F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_"), F.lit("")), F.lit("file"))


def slugify(text: Column) -> Column:
    """Lower case, other characters to single hyphens, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def embedding_key(text: Column, model: str, revision: str, dimension: int, normalized: bool) -> Column:
    """The name of a text's cached vector: another model, revision, size or normalisation is another vector."""
    return F.sha2(F.concat_ws("|", F.coalesce(text, F.lit("")), F.lit(model), F.lit(revision), F.lit(str(dimension)), F.lit(str(normalized))), 256)


def model_tier(query: Column, n_documents: Column) -> Column:
    """STRONG for several documents, a comparison or several question words; else FAST."""
    strong = (n_documents > 1) | query.rlike(COMPARISON) | (F.regexp_count(query, F.lit(QUESTION)) > 1)
    return F.when(strong, "STRONG").otherwise("FAST")


def roman_to_int(text: Column) -> Column:
    """A roman number's value, also of unusual spellings; null for other letters or beyond 1 to 3999."""
    value = F.create_map(*(x for k, v in ROMAN.items() for x in (F.lit(k), F.lit(v))))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("last"))

    def add(state, letter):
        now = F.try_element_at(value, letter)
        return F.struct((state["total"] + F.when(now < state["last"], -now).otherwise(now)).alias("total"), F.greatest(state["last"], now).alias("last"))

    total = F.aggregate(F.reverse(F.split(F.lower(text), "")), start, add)["total"]
    return F.when(F.lower(text).rlike("^[ivxlcdm]+$") & total.between(1, 3999), total)


def detect_numbering(text: Column) -> Column:
    """(style, marker) of a line's leading number: the first form that fits; a roman form must be a roman number."""
    text, out = F.trim(text), F.lit(None).cast("struct<style:string,marker:string>")
    for pattern, style in reversed(MARKERS):
        marker = F.regexp_extract(text, pattern, 1)
        fits = text.rlike(pattern)
        if style.startswith("ROMAN"):
            fits = fits & roman_to_int(marker).isNotNull()
        out = F.when(fits, F.struct(F.lit(style).alias("style"), marker.alias("marker"))).otherwise(out)
    return out


def defang(text: Column) -> Column:
    """Delimiter lines and lines that pose as section headers, marked as quotations."""
    quoted = F.regexp_replace(text, DELIMITER_LINE, "[quoted from document: $0]")
    return F.regexp_replace(quoted, HEADER_LINE, "[quoted from document: $0]")


def parse_reference(query: Column) -> Column:
    """The structural reference in a query: kind, article, clause, letter, appendix, decision and path terms in order.

    References are read from left to right; of several values of one kind the last counts. The kinds rank ARTICLE,
    APPENDIX, DECISION, GENERIC_PATH, and only the chosen kind's fields are filled; all null if there is none.
    """
    found = F.regexp_extract_all(query, F.lit(REFERENCE), F.lit(0))
    pairs = F.transform(found, lambda m: F.struct(F.lower(F.element_at(F.split(m, r"\s+"), 1)).alias("word"), F.regexp_replace(F.element_at(F.split(m, r"\s+"), -1), r"[()]", "").alias("value")))

    def fields(pairs: Column) -> Column:
        def last(*words: str) -> Column:
            return F.try_element_at(F.filter(pairs, lambda p: p["word"].isin(*words)), F.lit(-1))["value"]

        article, appendix = F.lower(last("pasal")), F.upper(last("lampiran"))
        decision = F.upper(last(*(w.lower() for w in ORDINALS)))
        steps = F.filter(pairs, lambda p: p["word"].isin("huruf", "bab", "angka", "butir", "poin", "bagian"))
        terms = F.transform(steps, lambda p: F.when(p["word"] == "bab", F.upper(p["value"])).otherwise(F.lower(p["value"])))
        kind = F.when(article.isNotNull(), "ARTICLE").when(appendix.isNotNull(), "APPENDIX").when(decision.isNotNull(), "DECISION").when(F.size(terms) > 0, "GENERIC_PATH")

        def of(name: str, value: Column, field: str) -> Column:
            return F.when(kind == name, value).alias(field)

        return F.struct(
            kind.alias("kind"), of("ARTICLE", article, "article"), of("ARTICLE", last("ayat"), "clause"), of("ARTICLE", F.lower(last("huruf")), "letter"),
            of("APPENDIX", appendix, "appendix"), of("DECISION", decision, "decision"), of("GENERIC_PATH", terms, "terms"),
        )

    return F.element_at(F.transform(F.array(pairs), fields), 1)  # so the pattern is looked for once


def extension(path: Column) -> Column:
    """The lower-case ending of a file name with its dot, or an empty text."""
    return F.lower(F.regexp_extract(F.element_at(F.split(path, r"[/\\]"), -1), r"[^.](\.[^.]+)$", 1))


def mime_type(path: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in MIME.items() for x in pair)), extension(path)), F.lit("application/octet-stream"))


def title_of_file(path: Column) -> Column:
    """A file's name without folder and ending."""
    return F.regexp_replace(F.element_at(F.split(path, r"[/\\]"), -1), r"(?<=[^.])\.[^.]*$", "")


def is_lock_file(path: Column) -> Column:
    return path.rlike(LOCK_FILE)


def unc_host(path: Column) -> Column:
    """The host of a network path of two leading slashes of either kind, in lower case; null if it is none."""
    return F.nullif(F.lower(F.regexp_extract(path, r"^(?:\\\\|//)([^\\/]+)[\\/]", 1)), F.lit(""))


def estimated_cost(tier: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """Dollars of an answer by its tier's rate for 1,000 tokens; null if anything is missing or the tier has no rate."""
    rate = F.try_element_at(F.create_map(*(x for k, v in COST_PER_1K.items() for x in (F.lit(k), F.lit(v).cast("decimal(10,6)")))), tier)
    return ((tokens_in + tokens_out).cast("decimal(12,0)") / 1000 * rate).cast("decimal(14,6)")


def shown_latency(ms: Column) -> Column:
    """Milliseconds below one second, else seconds with one decimal."""
    return F.when(ms.isNull(), "-").when(ms < 1000, F.concat(F.round(ms).cast("long").cast("string"), F.lit("ms"))).otherwise(F.format_string("%.1fs", ms / 1000))


def shown_age(seconds: Column) -> Column:
    """An age in hours below one day, else in days."""
    hours = F.floor(seconds / 3600 + 0.5).cast("long")
    return F.when(hours < 1, "just now").when(hours < 24, F.format_string("%dh ago", hours)).otherwise(F.format_string("%dd ago", F.floor(hours / 24 + 0.5).cast("long")))
