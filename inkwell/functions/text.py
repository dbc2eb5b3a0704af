"""Text functions as Column expressions; Python runs for nfkc only, which Spark has no function for."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from inkwell.functions import lexicons as lx

TOKEN = r"[a-z0-9][a-z0-9\-_.]*"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strings(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def tokens(text: Column | str, stopwords: Sequence[str] = lx.SEARCH_STOPWORDS) -> Column:
    """Search tokens in text order, repeats kept; identifiers such as f1_score or 0.89 stay whole."""
    found = F.regexp_extract_all(F.lower(_col(text)), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*stopwords))


def content_terms(text: Column | str, stopwords: Sequence[str] = lx.JUDGE_STOPWORDS) -> Column:
    """The distinct content words of a judged text: marks at the ends stripped, three characters or more."""
    found = F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit(TOKEN), F.lit(0))
    bare = F.transform(found, lambda t: F.regexp_replace(t, r"^[.\-_]+|[.\-_]+$", ""))
    return F.array_distinct(F.filter(bare, lambda t: (F.length(t) >= 3) & ~t.isin(*stopwords)))


def sentences(text: Column | str) -> Column:
    """Split after . ! or ? and white space; trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(_col(text), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def cut_sentences(text: Column | str) -> Column:
    """Split after every . ! and ?, also within numbers; what follows the last one counts if it is not empty."""
    return F.filter(F.split(_col(text), r"(?<=[.!?])"), lambda s: s != "")


def claims(text: Column | str, markers: Sequence[str] = lx.CLAIM_MARKERS, limit: int = 6, lengths: tuple[int, int] = lx.CLAIM_LENGTHS) -> Column:
    """The first sentences of fitting length that hold a marker."""
    stated = F.transform(cut_sentences(text), lambda s: F.trim(s))
    has = lambda s: F.exists(strings(markers), lambda m: F.contains(F.lower(s), m))
    return F.slice(F.filter(stated, lambda s: F.length(s).between(*lengths) & has(s)), 1, limit)


def long_words(text: Column | str) -> Column:
    """Distinct lower-case words of more than four characters, marks kept."""
    return F.array_distinct(F.filter(F.split(F.lower(_col(text)), r"\s+"), lambda w: F.length(w) > 4))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def supporting(query: Column, text: Column | str, limit: int = 3) -> Column:
    """Up to `limit` sentences of 20 characters or more that share query terms: most shared first, then text order."""
    numbered = F.transform(F.filter(sentences(text), lambda s: F.length(s) >= 20), lambda s, i: F.struct((-F.size(F.array_intersect(tokens(s), query))).alias("score"), i.alias("at"), s.alias("sentence")))
    return F.transform(F.slice(F.array_sort(F.filter(numbered, lambda z: z["score"] < 0)), 1, limit), lambda z: z["sentence"])


def normalize_key(value: Column | str) -> Column:
    """Lower case, single spaces, outer punctuation stripped."""
    spaced = F.regexp_replace(F.lower(_col(value)), r"(?U)\s+", " ")
    return F.regexp_replace(spaced, r"^[ .,;:()\[\]{}\"']+|[ .,;:()\[\]{}\"']+$", "")


def canonical_metric(name: Column | str) -> Column:
    key = normalize_key(name)
    return F.coalesce(F.create_map(*(F.lit(x) for pair in lx.METRIC_ALIASES.items() for x in pair))[key], key)


def higher_is_better(metric: Column | str) -> Column:
    return ~canonical_metric(metric).isin(*lx.LOWER_IS_BETTER)


def better_of(metric: Column | str, a: Column, b: Column) -> Column:
    return F.when(higher_is_better(metric), F.greatest(a, b)).otherwise(F.least(a, b))


def estimate_tokens(text: Column | str) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(_col(text)) / 4).cast("int"))


def authors(raw: Column | str, limit: int = 50) -> Column:
    """An author string split at ; , & and the word and; repeats kept."""
    parts = F.split(F.regexp_replace(_col(raw), r";|,| and |&", "|"), r"\|")
    bare = F.transform(parts, lambda a: F.regexp_replace(a, r"^[ .\t\n]+|[ .\t\n]+$", ""))
    return F.slice(F.filter(bare, lambda a: F.length(a).between(3, 80) & a.rlike(r"\p{L}")), 1, limit)


def cited(answer: Column | str, n_sources: Column) -> Column:
    """The distinct source numbers that an answer's [n] markers name, in order."""
    found = F.transform(F.regexp_extract_all(_col(answer), F.lit(r"\[(\d{1,2})\]"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda i: i.between(1, n_sources))))


def all_markers(answer: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(_col(answer), F.lit(r"\[(\d+)\]"), F.lit(1)))


def sanitize(text: Column | str, limit: int | None = 2000) -> Column:
    """Hidden characters removed, white space collapsed, length capped; limit None: the whole text."""
    shown = F.regexp_replace(_col(text), lx.INVISIBLE, "")
    plain = F.trim(F.regexp_replace(shown, r"\s+", " "))
    return plain if limit is None else F.substring(plain, 1, limit)


def injection_match(text: Column | str, patterns: Sequence[str] = lx.INJECTION_PATTERNS) -> Column:
    """The first 60 characters that the first matching pattern found; null if none matches."""
    return F.coalesce(*(F.nullif(F.substring(F.regexp_extract(_col(text), f"(?i)({p})", 1), 1, 60), F.lit("")) for p in patterns))


def refuses(text: Column | str, markers: Sequence[str] = lx.REFUSAL_MARKERS) -> Column:
    return F.exists(strings(markers), lambda m: F.contains(F.lower(_col(text)), m))


def clamp_confidence(value: Column | str, default: float = 0.5) -> Column:
    number = _col(value).try_cast("double")
    return F.when(number.isNull(), default).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))


def json_object(raw: Column | str) -> Column:
    """The JSON object of a model's reply: fences stripped, else what lies between the outer braces; null if neither parses."""
    bare = F.trim(F.regexp_replace(F.trim(_col(raw)), r"^`{3}(?:json)?\s*|\s*`{3}$", ""))
    inner = F.regexp_extract(_col(raw), r"(?s)(\{.*\})", 1)
    is_object = lambda x: F.schema_of_variant(F.try_parse_json(x)).startswith("OBJECT")
    return F.when(is_object(bare), bare).when(is_object(inner), inner)


def source_label(title: Column, section: Column, page: Column) -> Column:
    """title — section — p. N, without the parts that are missing."""
    return F.concat_ws(" — ", title, F.nullif(section, F.lit("")), F.when(page > 0, F.concat(F.lit("p. "), page.cast("string"))))


def bibtex_key(authors_raw: Column, year: Column, title: Column) -> Column:
    """Last word of the first author, year, first word of the title: ASCII letters and digits only."""
    slug = lambda x, n: F.substring(F.regexp_replace(F.lower(x), "[^a-z0-9]", ""), 1, n)
    first = F.element_at(F.split(F.trim(F.split(F.coalesce(authors_raw, F.lit("")), ",")[0]), r"\s+"), -1)
    word = F.split(F.trim(F.coalesce(title, F.lit(""))), r"\s+")[0]
    return F.concat(slug(first, 20), F.coalesce(year.cast("string"), F.lit("")), slug(word, 12))


def storage_key(checksum: Column, filename: Column) -> Column:
    ext = F.lower(F.regexp_extract(filename, r"(\.[^./\\]+)$", 1))
    return F.concat(F.lit("papers/"), F.substring(checksum, 1, 2), F.lit("/"), F.substring(checksum, 3, 2), F.lit("/"), checksum, F.when(ext == "", ".bin").otherwise(ext))


@F.pandas_udf(StringType())
def nfkc(name: pd.Series) -> pd.Series:
    """Compatibility forms (full-width letters, slashes, dots) as the plain characters they stand for."""
    return name.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def general(value: Column | str) -> Column:
    """A number in six significant digits without trailing zeros, in scientific form from a million and below 0.0001."""
    digits = F.format_string("%.5e", _col(value))
    number, power = digits.cast("double"), F.element_at(F.split(digits, "e"), 2).cast("int")
    plain = F.regexp_replace(number.cast("decimal(24,10)").cast("string"), r"\.?0+$", "")
    return F.when(number == 0, "0").when(power.between(-4, 5), plain).otherwise(F.regexp_replace(digits, r"\.?0+e", "e"))


def safe_filename(name: Column, limit: int = 255, fallback: str = "upload.pdf") -> Column:
    """Base name only, unusual characters to _, runs of dots to one; a reserved device name gets a prefix, a long name loses the end of its stem, and one of which nothing is left becomes the fallback."""
    base = F.element_at(F.split(name, r"[/\\]"), -1)
    clean = F.regexp_replace(F.regexp_replace(base, r"[^\w.\- ]", "_"), r"\.{2,}", ".")
    clean = F.regexp_replace(clean, r"^[. ]+|[. ]+$", "")
    clean = F.when(clean.rlike(r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])\.[^.]*$"), F.concat(F.lit("file_"), clean)).otherwise(clean)
    ending = F.regexp_extract(clean, r"(\.[^.]*)$", 1)
    short = F.concat(F.substring(clean, F.lit(1), F.lit(limit) - F.length(ending)), ending)
    return F.when(F.coalesce(clean, F.lit("")) == "", fallback).when(F.length(clean) > limit, short).otherwise(clean)


def status_class(code: Column) -> Column:
    return F.concat(F.floor(code / 100).cast("string"), F.lit("xx"))


def relative_gap(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-9))


def answer_confidence(n_sources: Column, sufficient: Column, n_cited: Column, supported: Column, verified: Column) -> Column:
    base = F.lit(0.5) + F.when(sufficient, 0.2).otherwise(0.0) + F.when(n_cited > 0, 0.1).otherwise(0.0)
    judged = F.when(supported, F.greatest(base, verified)).otherwise(F.least(base, F.lit(0.35)))
    return F.when(n_sources == 0, 0.0).otherwise(F.round(judged, 2))


def markdown_table(rows: Column) -> Column:
    """array<array<string>> as a Markdown table: ragged rows padded, bars escaped; empty in, empty out."""
    width = F.array_max(F.transform(rows, F.size))
    cell = lambda c: F.replace(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")), F.lit("|"), F.lit("\\|"))
    padded = F.transform(rows, lambda r: F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), width - F.size(r))))
    lines = F.transform(padded, lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |")))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    whole = F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))), "\n")
    return F.when((F.size(rows) > 0) & (width > 0), whole).otherwise("")


def abstract(text: Column | str, limit: int = 5000) -> Column:
    """What follows the word Abstract, up to the next opening heading."""
    after = F.regexp_extract(_col(text), r"(?s)(?:\b[Aa]\s?[Bb]\s?[Ss]\s?[Tt]\s?[Rr]\s?[Aa]\s?[Cc]\s?[Tt]\b\s*[-—:.]?)(.*)", 1)
    until = F.split(after, r"\n\s*(?:(?:[IVX]+|\d+)[.)]?\s*)?(?:INTRODUCTION|Introduction|KEYWORDS|Keywords|Index Terms|CCS CONCEPTS)\b")[0]
    return F.nullif(F.substring(F.trim(F.regexp_replace(until, r"\s+", " ")), 1, limit), F.lit(""))
