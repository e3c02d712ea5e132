"""Secrets in texts, and parts of credentials that only count together, in SQL functions.

Base kinds are found anywhere.  Weak parts are reported only near their complement: identifiers (access keys, account
and user names), long mixed tokens, and endpoints are intervals of a text; an identifier's scope reaches ``SCOPE``
characters to both sides, and intervals meet in a join on text and bucket of positions.  A token in an identifier's
scope is reported with it, and so is an endpoint in the scope of such an identifier.

Positions come from splitting a text at the same pattern that extracts the matches: a match starts after the pieces
and matches before it.  Positions are code points, ends exclusive.  Null text counts as empty and has no spans.
Repeated texts are linked once, by their digest; parts of texts with an identifier are stored, so that no text is searched
twice.  Rows need no id, and other columns stay as they are.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from stridelake.llm.store import kept_table

#: Base kinds in the order that breaks ties, as fixed values: Java patterns, and the least length of a match.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_VALUE = 6
BASE = ("assign", "access", "hex")
#: Weak parts.  An identifier's name may follow a prefix that ends in another sign than a letter or digit, as in AZURE_CLIENT_ID.
IDENTIFIER = r"""(?i)(?<![A-Za-z0-9])(access_?key_?id|client_?id|account_?sid|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}"""
#: Tokens may be of any length and stand right after "=", which only at their end belongs to them; taken whole, so the search stays linear.
TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/=_-])"
ENDPOINT = r"""(?i)\b(https?|ftp|jdbc:[a-z]+|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\s"'<>]+"""
#: A text without any of these has no identifier.
IDENTIFIER_HINT = r"AKIA[A-Z0-9]{16}|(?i)(access_?key_?id|client_?id|account_?sid|user_?name|login)[\"']?\x20*[:=]"
KINDS = (*BASE, "link_id", "link_secret", "link_endpoint")
#: Characters that an identifier's scope reaches to both sides.
SCOPE = 300

_SPANS = "array<struct<start:int,rank:int,end:int>>"


def _found(df: DataFrame, text: Column, name: str, pattern: str, kind: str, keep=None) -> DataFrame:
    """``df`` with the spans of a pattern as array ``__<name>``."""
    matches, pieces = f"__{name}_m", f"__{name}_p"
    df = df.withColumn(matches, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    df = df.withColumn(pieces, F.when(F.size(matches) > 0, F.split(text, pattern, -1)))
    start = F.struct(F.array().cast("array<struct<start:int,rank:int,end:int,ok:boolean>>").alias("spans"), F.lit(0).alias("at"))

    def step(state, i):
        match = F.get(F.col(matches), i)
        begin = state["at"] + F.length(F.get(F.col(pieces), i))
        end = begin + F.length(match)
        one = F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), (keep(match) if keep else F.lit(True)).alias("ok"))
        return F.struct(F.concat(state["spans"], F.array(one)).alias("spans"), end.alias("at"))

    walked = F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), start, step, lambda s: s["spans"])
    kept = F.transform(F.filter(walked, lambda x: x["ok"]), lambda x: F.struct(x["start"], x["rank"], x["end"]))
    return df.withColumn(f"__{name}", F.when(F.size(matches) > 0, kept).otherwise(F.array().cast(_SPANS))).drop(matches, pieces)


def _base(df: DataFrame, text: Column) -> DataFrame:
    long_enough = lambda match: F.length(F.regexp_extract(match, ASSIGN, 2)) >= ASSIGN_VALUE
    df = _found(df, text, "assign", ASSIGN, "assign", long_enough)
    return _found(_found(df, text, "access", ACCESS, "access"), text, "hex", HEX, "hex")


def _links(parts: DataFrame) -> DataFrame:
    """``__key, __links`` of texts, from their parts."""
    base = F.concat("__assign", "__access", "__hex")
    weak = F.filter("__token", lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (b["end"] > t["start"])))
    bucket = lambda position: F.floor(position / SCOPE)
    names = parts.select("__key", F.explode(F.concat("__access", "__identifier")).alias("i"))
    scopes = names.select("__key", "i", F.explode(F.sequence(bucket(F.greatest(F.col("i.start") - SCOPE, F.lit(0))), bucket(F.col("i.end") + SCOPE))).alias("bucket"))

    def spread(column):
        one = parts.select("__key", F.explode(column).alias("x"))
        return one.select("__key", "x", F.explode(F.sequence(bucket(F.col("x.start")), bucket(F.col("x.end")))).alias("bucket"))

    near = (F.col("x.start") < F.col("i.end") + SCOPE) & (F.col("x.end") > F.col("i.start") - SCOPE)
    # Base matches are secrets too: they make an identifier count, but are reported already.
    secrets = spread(F.concat(weak, F.filter(base, lambda b: b["rank"] != KINDS.index("access"))))
    pairs = scopes.join(secrets, ["__key", "bucket"]).where(near).select("__key", "i", "x").distinct()
    complete = pairs.select("__key", "i").distinct()
    ends = scopes.join(complete, ["__key", "i"]).join(spread(F.col("__endpoint")), ["__key", "bucket"]).where(near).select("__key", "x")
    reported = pairs.select("__key", "x").union(pairs.select("__key", F.col("i").alias("x"))).union(ends).where(~F.col("x.rank").isin(*range(len(BASE))))
    return reported.groupBy("__key").agg(F.array_sort(F.collect_set("x")).alias("__links"))


def with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with arrays of (start, rank of the kind in ``KINDS``, end): ``__assign, __access, __hex`` and ``__links``.

    Texts without an identifier have no links and are not shuffled.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hinted = docs.withColumn("__hint", text.rlike(IDENTIFIER_HINT))
    plain = _base(hinted.where("not __hint"), text).withColumn("__links", F.array().cast(_SPANS))
    rich = hinted.where("__hint").withColumn("__key", F.sha2(text, 256))
    # Parts are used several times; stored, they are searched for once.
    parts = _base(rich.select("__key", text.alias("__text")), F.col("__text"))
    for name, pattern, kind in (("identifier", IDENTIFIER, "link_id"), ("token", TOKEN, "link_secret"), ("endpoint", ENDPOINT, "link_endpoint")):
        parts = _found(parts, F.col("__text"), name, pattern, kind)
    parts = kept_table(parts.drop("__text").dropDuplicates(["__key"]), "parts")
    spans = parts.select("__key", "__assign", "__access", "__hex").join(_links(parts), "__key", "left")
    joined = rich.join(spans, "__key").withColumn("__links", F.coalesce("__links", F.array().cast(_SPANS)))
    names = [*docs.columns, "__assign", "__access", "__hex", "__links"]
    return plain.select(*names).unionByName(joined.select(*names))


def _listed(spans: Column) -> Column:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])), ",")


def secret_spans(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256 and spans (``kind:start:end``, by start, then kind)."""
    found = with_spans(docs.select("doc_id", "text"))
    base = F.concat("__assign", "__access", "__hex")
    counts = [F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.concat(base, "__links")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mark`` (overlapping spans by one); other columns stay."""
    found = with_spans(docs).withColumn("__all", F.array_sort(F.concat("__assign", "__access", "__hex", "__links")))
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def merge(done, s):
        last = F.element_at(done, -1)
        overlaps = (F.size(done) > 0) & (s["start"] < F.coalesce(F.get(done, F.size(done) - 1)["end"], F.lit(-1)))
        wider = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when(overlaps, wider).otherwise(F.concat(done, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))))

    found = found.withColumn("__merged", F.when(F.size("__all") > 0, F.aggregate("__all", empty, merge)).otherwise(empty))
    before = lambda i: F.coalesce(F.get(F.col("__merged"), i - 1)["end"], F.lit(0))
    pieces = F.transform("__merged", lambda s, i: F.concat(F.substring(F.col("text"), before(i) + 1, s["start"] - before(i)), F.lit(mark)))
    tail = F.substring(F.col("text"), F.element_at("__merged", -1)["end"] + 1, F.length("text"))
    clean = F.when(F.size("__merged") > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(F.col("text"))
    return found.withColumn("text", clean).select(*docs.columns)
