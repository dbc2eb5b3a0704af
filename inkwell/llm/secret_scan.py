"""Operator 9: secrets, and weak candidates that complementary parts confirm.

Strong kinds stand alone: a keyword with a value of 12 or more characters
(assign), an access identifier (access) and a long hexadecimal run (hex).
Weak kinds are too common to report by themselves: mixed-case runs of 20 or
more characters (secret), keywords with a value of 6 to 11 characters (short),
user names (user) and addresses (endpoint).  Within a document, each candidate
interval, widened by SCOPE code points to both sides, is joined with the
intervals of complementary kinds that it meets, and it is reported only then:

    secret, short   near an access identifier, a user name or an endpoint
    user            near an assign, secret or short
    endpoint        near an assign, secret or short and near an access or user

Only DataFrame functions are used, and no row leaves its task: a document's
intervals are an array column, so the interval join needs no shuffle and a hot
source costs no more than its texts.

Positions are code points, end exclusive.  Matches of a kind are leftmost and
do not overlap; positions come from the lengths of the pieces between matches.
Defined results: a null or empty text has no spans; repeated rows each get
their own result; other columns pass through whatever their names, except that
the result's own secrets replaces a column of that name in any case.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.columns import aside, back, running_sums

SCOPE = 200


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The patterns of the strong kinds.
ASSIGN = f"({'|'.join(map(_any_case, ('password', 'passwd', 'secret', 'token')))}|{_any_case('api')}_?{_any_case('key')})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{14,}"  # the same as runs of AKIA[A-Z0-9]+ with 18 or more characters
HEX = "[0-9a-f]{16,}"  # the same as runs of [0-9a-f]+ with 16 or more characters
RUN = "[A-Za-z0-9+/_=-]{20,}"
USER = f"({'|'.join(map(_any_case, ('username', 'user', 'login')))})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9._@-]{{3,}})"
ENDPOINT = "https?://[^\\x20\\x09-\\x0D\"'<>]+"
KINDS = ("assign", "access", "hex", "secret", "short", "user", "endpoint")
_SPANS = "array<struct<start:int,end:int>>"


def _spans(text: Column, pattern: str, keep=None) -> Column:
    """The intervals of the matches; keep: a predicate over (match, its second group)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    gaps, sizes = F.transform(F.slice(between, F.lit(1), F.size(found)), lambda x: F.length(x)), F.transform(found, lambda x: F.length(x))
    ends = running_sums(F.zip_with(gaps, sizes, lambda g, n: g + n))
    placed = F.zip_with(ends, sizes, lambda e, n: F.struct((e - n).alias("start"), e.alias("end")))
    if keep is not None:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if "](" in pattern or "?(" in pattern else found
        both = F.arrays_zip(placed.alias("span"), values.alias("value"))
        placed = F.transform(F.filter(both, lambda z: keep(z["value"])), lambda z: z["span"])
    return F.when(text.rlike(pattern), placed).otherwise(F.array().cast(_SPANS))


def _near(x: Column, spans: Column, scope: int) -> Column:
    """Whether x, widened by scope, meets one of the spans, which are in order and apart.

    Of those that start before x ends, the last one ends last; it is found by
    halving, so a text's candidates are never compared all with all.
    """
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + F.lit(1.0))).cast("int"))
    halve = lambda at: F.floor((at["lo"] + at["hi"]) / 2).cast("int")
    before = lambda at: F.get(spans, halve(at))["start"] < x["end"] + scope
    last = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi")),
        lambda at, _: F.when(at["lo"] >= at["hi"], at).when(before(at), F.struct((halve(at) + 1).alias("lo"), at["hi"].alias("hi"))).otherwise(F.struct(at["lo"].alias("lo"), halve(at).alias("hi"))),
        lambda at: at["lo"] - 1,
    )
    return F.coalesce(F.get(spans, last)["end"] > x["start"] - scope, F.lit(False))


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """docs plus secrets: array of (start, end, kind number, kind) in order of start, then kind."""
    rows = aside(docs, "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    long_enough = lambda v: F.length(v) >= 12
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[A-Z]") & v.rlike("[a-z]")
    parts = rows.select(
        "*",
        F.struct(
            _spans(text, ASSIGN, long_enough).alias("assign"),
            _spans(text, ACCESS).alias("access"),
            _spans(text, HEX).alias("hex"),
            _spans(text, RUN, mixed).alias("secret"),
            _spans(text, ASSIGN, lambda v: F.length(v).between(6, 11)).alias("short"),
            _spans(text, USER).alias("user"),
            _spans(text, ENDPOINT).alias("endpoint"),
        ).alias("__ss"),
    )
    p = lambda kind: F.col(f"__ss.{kind}")
    met = lambda x, *kinds: reduce(or_, (_near(x, p(kind), scope) for kind in kinds))
    apart = lambda x: ~reduce(or_, (_near(x, p(kind), 0) for kind in ("assign", "access", "hex", "short", "endpoint")))
    linked = {
        "assign": p("assign"), "access": p("access"), "hex": p("hex"),
        "secret": F.filter(p("secret"), lambda x: apart(x) & met(x, "access", "user", "endpoint")),
        "short": F.filter(p("short"), lambda x: met(x, "access", "user", "endpoint")),
        "user": F.filter(p("user"), lambda x: met(x, "assign", "secret", "short")),
        "endpoint": F.filter(p("endpoint"), lambda x: met(x, "assign", "secret", "short") & met(x, "access", "user")),
    }
    label = lambda rank, kind: lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"))
    labelled = [F.transform(linked[kind], label(rank, kind)) for rank, kind in enumerate(KINDS)]
    anything = F.exists(F.array(*(F.size(p(k)) for k in KINDS)), lambda n: n > 0)
    in_order = F.array_sort(F.concat(*labelled), lambda a, b: F.when((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["rank"] < b["rank"])), -1).when((a["start"] == b["start"]) & (a["rank"] == b["rank"]), 0).otherwise(1))
    none = F.array().cast("array<struct<start:int,end:int,rank:int,kind:string>>")
    return back(parts.withColumn("secrets", F.when(anything, in_order).otherwise(none)), docs, ("text",), ("secrets",))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
