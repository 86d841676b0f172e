"""Secret scan by trigram inverted index, in DataFrame operations only.

From each rule's regular expression a Boolean query over trigrams is derived:
text that matches must hold, in lower case, all trigrams of one of a few
alternatives. The inverted index is a table written between phases: for each
trigram that any rule asks for the postings, keys of the rows that hold it. A
rule's candidates are the rows in the intersections and unions of postings that
its query names; lists are intersected by bringing the postings of a row
together, with map-side combine, as a row has a bit for each of its lists.
Candidates meet the texts again by a join on the row's key and are verified by
the expression itself. A rule without mandatory trigrams reads every text.

A row's key is a 64-bit hash of doc_id and text. Rows that repeat both share
it, and rightly so; where two others do, one more text is verified.

Positions: ``split`` gives the text between matches and ``regexp_extract_all``
the matches, both leftmost and non-overlapping; adding their lengths in turn
gives each match's place in code points.

Defined results: null text is empty and has no spans; every row of the input
gives a row, repeated rows and a null doc_id too; texts are read whole; an
empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import re._constants as sre
import re._parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Exact alternatives that are followed at once while a query is derived.
MAX_ALTERNATIVES = 48


@dataclass(frozen=True)
class Rule:
    """least: code points that ``group`` of a match must have."""

    name: str
    pattern: str
    group: int = 0
    least: int = 0


# The base kinds, in the order that breaks ties between spans.
# Key words are written with both cases; matching is case-sensitive throughout.
BASE = (
    Rule("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
# Formats that public providers document for their credentials.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + MORE

#: All of these groups must hold; a group holds if all trigrams of one of its alternatives are present.
Query = tuple[frozenset[frozenset[str]], ...]


def trigram_query(pattern: str) -> Query:
    """The trigrams, in lower case, that any text with a match must hold; () if there are none."""
    groups: list[frozenset[frozenset[str]]] = []
    rest = _walk(re._parser.parse(pattern), {""}, groups)
    _require(rest, groups)
    return tuple(dict.fromkeys(groups))


def _require(strings: set[str], groups: list) -> None:
    options = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    if strings and frozenset() not in options:
        groups.append(frozenset(o for o in options if not any(p < o for p in options)))


def _walk(node, heads: set[str], groups: list) -> set[str]:
    """Follow the parts of a concatenation; heads: what may stand just before, exactly."""
    for op, arg in node:
        options = _exact(op, arg)
        if options is not None and len(heads) * len(options) <= MAX_ALTERNATIVES:
            heads = {h + o for h in heads for o in options}
            continue
        _require(heads, groups)
        heads = {""}
        if options is not None and len(options) <= MAX_ALTERNATIVES:
            heads = options
        elif op is sre.SUBPATTERN:
            heads = _walk(arg[-1], heads, groups)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
            inner: list = []
            _require(_walk(arg[2], {""}, inner), inner)
            groups += inner
    return heads


def _exact(op, arg) -> set[str] | None:
    """All strings that one part can match, in lower case, or None if they are many."""
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN:
        out: set[str] = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                out.add(chr(value).lower())
            elif kind is sre.RANGE and value[1] - value[0] < 4:
                out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return out if len(out) <= 6 else None
    if op is sre.SUBPATTERN:
        return _series(arg[-1])
    if op is sre.BRANCH:
        parts = [_series(branch) for branch in arg[1]]
        return None if None in parts else set().union(*parts)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, body = arg
        one = _series(body)
        if one is None or high > 2:
            return None
        out = set()
        for n in range(low, high + 1):
            many = {""}
            for _ in range(n):
                many = {m + o for m in many for o in one}
            out |= many
        return out
    if op is sre.AT:
        return {""}
    return None


def _series(node) -> set[str] | None:
    out = {""}
    for op, arg in node:
        part = _exact(op, arg)
        if part is None or len(out) * len(part) > MAX_ALTERNATIVES:
            return None
        out = {a + b for a in out for b in part}
    return out


def vocabulary(rules: tuple[Rule, ...] = RULES) -> list[str]:
    """The trigrams that the index covers, for these rules."""
    return sorted({t for r in rules for group in trigram_query(r.pattern) for option in group for t in option})


_KEY = "_row_key"


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Names a row alike in the index and in the table."""
    return F.xxhash64(F.col(doc_id).cast("string"), F.coalesce(F.col(text).cast("string"), F.lit("")))


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The index: (trigram, row), trigram the number in ``vocabulary``, row the key of a row that holds it."""
    # a column of its own, or the text is lowered anew for each trigram
    lowered = docs.select(row_key().alias("row"), F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("low"))
    held = F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(k)) for k, t in enumerate(vocabulary(rules))])
    return lowered.select("row", F.explode(F.array_compact(held)).alias("trigram")).select("trigram", "row")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(row, rules): the rows in the intersected postings of rules, a bit for each rule; only rules with mandatory trigrams."""
    trigrams = vocabulary(rules)
    at = {t: k for k, t in enumerate(trigrams)}
    words = range(0, len(trigrams), 62)
    bits = [F.bit_or(F.when(F.col("trigram").between(lo, lo + 61), F.expr(f"shiftleft(1L, trigram - {lo})")).otherwise(F.lit(0).cast("long"))).alias(f"w{k}") for k, lo in enumerate(words)]

    def option(needed: frozenset[str]) -> Column:
        masks: dict[int, int] = {}
        for t in needed:
            masks[at[t] // 62] = masks.get(at[t] // 62, 0) | 1 << at[t] % 62
        out = F.lit(True)
        for w, mask in sorted(masks.items()):
            out = out & (F.col(f"w{w}").bitwiseAND(F.lit(mask).cast("long")) == F.lit(mask).cast("long"))
        return out

    found = F.lit(0)
    for k, rule in enumerate(rules):
        query = trigram_query(rule.pattern)
        if not query:
            continue
        all_ = F.lit(True)
        for group in query:
            some = F.lit(False)
            for needed in sorted(group, key=sorted):
                some = some | option(needed)
            all_ = all_ & some
        found = found + F.when(all_, F.lit(1 << k)).otherwise(F.lit(0))
    return index.groupBy("row").agg(*bits).select("row", found.alias("rules")).where("rules <> 0")


_SPAN = "array<struct<start:int,kind:int,end:int>>"


def match_spans(text: Column, rule: Rule, kind: int) -> Column:
    """Places of a rule's matches, in code points, end exclusive."""
    pattern = F.lit(rule.pattern)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    sized = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.least else hits
    parts = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), hits.alias("hit"), sized.alias("value"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("found"))

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["gap"])
        end = start + F.coalesce(F.length(part["hit"]), F.lit(0))
        fits = part["hit"].isNotNull() & (F.length(part["value"]) >= F.lit(rule.least))
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(fits, F.concat(state["found"], span)).otherwise(state["found"]).alias("found"))

    return F.aggregate(parts, begin, step, lambda state: state["found"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with ``_spans``: the places of all secrets, by start and then kind; kind is the rule's number."""
    work = Workspace(docs.sparkSession, "secret-scan")
    index = work.write(postings(docs, rules), "postings")
    found = work.write(candidates(index, rules).withColumnsRenamed({"row": _KEY, "rules": "_rules"}), "candidates")
    work.drop("postings")
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    none = F.array().cast(_SPAN)
    spans = []
    for kind, rule in enumerate(rules):
        candidate = F.col("_rules").bitwiseAND(F.lit(1 << kind)) != 0 if trigram_query(rule.pattern) else F.lit(True)
        spans.append(F.when(candidate & whole.rlike(rule.pattern), match_spans(whole, rule, kind)).otherwise(none))
    marked = docs.withColumn(_KEY, row_key()).join(found, _KEY, "left").withColumn("_rules", F.coalesce("_rules", F.lit(0)))
    return marked.withColumn("_spans", F.array_sort(F.concat(*spans))).drop(_KEY, "_rules")


def secret_scan(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds and places of all secrets of each document.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256 and spans; a span is
    kind:start:end, by start and then kind, joined by commas.
    """
    name = F.array(*[F.lit(r.name) for r in RULES])

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")

    def count(kind: int) -> Column:
        return F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{BASE[kind].name}")

    base = F.filter("_spans", lambda s: s["kind"] < len(BASE))
    found = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return found.select("doc_id", *[count(k) for k in range(len(BASE))], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("_spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "<secret>") -> DataFrame:
    """docs with each secret in text replaced by a mark; overlapping ones by one mark. Null text stays null."""
    columns = docs.columns
    found = scan(docs.withColumnsRenamed({c: f"in_{c}" for c in columns if c in ("_spans", "_rules", _KEY)}))
    found = found.withColumnsRenamed({"_spans": "found_", **{f"in_{c}": c for c in columns if c in ("_spans", "_rules", _KEY)}})
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(state: Column, span: Column) -> Column:
        new = span["start"] >= state["at"]
        before = F.substring(F.col("text"), state["at"] + 1, span["start"] - state["at"])
        return F.struct(F.when(new, F.concat(state["out"], before, F.lit(mark))).otherwise(state["out"]).alias("out"), F.greatest(state["at"], span["end"]).alias("at"))

    def finish(state: Column) -> Column:
        return F.concat(state["out"], F.substring(F.col("text"), state["at"] + 1, F.length("text")))

    text = F.when(F.size("found_") > 0, F.aggregate("found_", begin, step, finish)).otherwise(F.col("text"))
    return found.withColumn("text", text).select(*columns)
