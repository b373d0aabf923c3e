"""Secret scans over a trigram inverted index, with DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived: whatever matches must hold them.  The index
has a posting (trigram, doc_id) for each trigram that some query asks for; queries intersect and unite postings by
document; only the documents that pass are verified with the regular expression itself.  A rule without mandatory
trigrams (a bare run of hexadecimal digits) scans every text.

Positions come from the texts between matches: with `split` and `regexp_extract_all` the lengths of gaps and matches
alternate, and their running sum gives code-point offsets.

Rules for odd input: null texts count as empty; each input row gives one output row, also where rows share an id (their
postings then unite, which can only add candidates); a null id is kept and its row scanned by every rule.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged


def either_case(*words: str) -> str:
    return "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in words)


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern` whose `group` has `least` characters or more are secrets of this kind.

    Where a backtracking engine would try a long run of characters from each of its places, `once` is a pattern with the
    same matches that tries it once; what its group `lead` holds comes before the match.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False
    once: str = ""
    lead: int = 0

    @property
    def scanned(self) -> str:
        return self.once or self.pattern


#: The base rules, in the order in which ties are listed.
BASE = (
    Rule("assign", f"({either_case('password', 'passwd', 'secret', 'token', 'api_?key')})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8, True),
    Rule("access", "AKIA[A-Z0-9]{12,}", 0, 16, True),  # AKIA[A-Z0-9]+ of 16 or more: a shorter run holds no longer one
    Rule("hex", "[0-9a-f]{32,}", 0, 32, True),  # [0-9a-f]+ of 32 or more, likewise
)
#: Formats of well-known credentials beside the base rules.
MORE = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", "[rs]k_live_[A-Za-z0-9]{16,}"),
    # if the first eyJ of a run has no match, no later one has: what follows the run is the same
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]+", once="(?<![A-Za-z0-9_-])((?:(?!eyJ)[A-Za-z0-9_-])*+)eyJ[A-Za-z0-9_-]{8,}+[.]eyJ[A-Za-z0-9_-]{8,}+[.][A-Za-z0-9_-]++", lead=1),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("url_password", "[a-z]+://[A-Za-z0-9._-]+:[^\\x20\\x09-\\x0D/@:]+@", once="(?<![a-z])[a-z]++://[A-Za-z0-9._-]++:[^\\x20\\x09-\\x0D/@:]++@"),
)
RULES = BASE + MORE

# ---------------------------------------------------------------- regular expression -> trigram query
# A query is True (no demand), a trigram, or ("and" | "or", {queries}).


def _join(op: str, parts) -> object:
    flat = set()
    for p in parts:
        if p is True:
            if op == "or":
                return True
        elif isinstance(p, tuple) and p[0] == op:
            flat |= p[1]
        else:
            flat.add(p)
    if not flat:
        return True
    return next(iter(flat)) if len(flat) == 1 else (op, frozenset(flat))


def _of_strings(strings: set[str]) -> object:
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in strings])


def _walk(nodes, most: int = 64) -> tuple[set[str] | None, object]:
    """(the strings that match, lower-cased, or None if unknown or too many; the query)."""
    exact: set[str] = {""}
    whole, demands = True, []
    for op, arg in nodes:
        name = str(op)
        if name == "LITERAL":
            got, query = {chr(arg).lower()}, True
        elif name == "IN" and (chars := _few(arg)):
            got, query = chars, True
        elif name == "SUBPATTERN":
            got, query = _walk(arg[-1])
        elif name == "BRANCH":
            ways = [_walk(w) for w in arg[1]]
            got = set().union(*(w[0] for w in ways)) if all(w[0] is not None for w in ways) else None
            query = True if got is not None else _join("or", [w[1] if w[0] is None else _of_strings(w[0]) for w in ways])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            lo, hi, what = arg
            inner, inner_query = _walk(what)
            if hi == 1 and inner is not None:
                got, query = inner | {""}, True
            else:
                got, query = None, (_join("and", [inner_query, _of_strings(inner) if inner is not None else True]) if lo else True)
        else:
            got, query = None, True
        if got is not None and len(exact) * len(got) <= most:
            exact = {a + b for a in exact for b in got}
            continue
        whole = False
        demands += [_of_strings(exact), query]
        exact = got if got is not None else {""}
    if whole:
        return exact, True
    return None, _join("and", [*demands, _of_strings(exact)])


def _few(arg, most: int = 8) -> set[str] | None:
    chars: set[str] = set()
    for op, x in arg:
        if str(op) == "LITERAL":
            chars.add(chr(x).lower())
        elif str(op) == "RANGE" and x[1] - x[0] < most:
            chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
        else:
            return None
        if len(chars) > most:
            return None
    return chars


def trigram_query(pattern: str) -> object:
    """The Boolean query over trigrams of the lower-cased text that each match of the pattern fulfils."""
    exact, query = _walk(re._parser.parse(pattern))
    return _join("and", [query, _of_strings(exact) if exact is not None else True])


def trigrams(query: object) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def _holds(query: object, have: Column) -> Column:
    if isinstance(query, str):
        return F.array_contains(have, query)
    parts = [_holds(q, have) for q in sorted(query[1], key=str)]
    out = parts[0]
    for p in parts[1:]:
        out = (out & p) if query[0] == "and" else (out | p)
    return out


# ---------------------------------------------------------------- index, queries, verification


def postings(docs: DataFrame, vocabulary: set[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index: (trigram, doc_id) for each document whose lower-cased text holds the trigram."""
    low = docs.select(F.lower(F.col(text_col)).alias("low"), F.col(id_col).alias("doc_id")).filter("doc_id is not null")  # lower-cased once, below the generator
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in sorted(vocabulary)]))
    return low.select(F.explode(held).alias("trigram"), "doc_id")


def candidates(index: DataFrame, queries: dict[str, object]) -> DataFrame:
    """(doc_id, kinds): the rules whose query the postings of a document fulfil.  At most one entry per trigram meets in a group."""
    have = index.groupBy("doc_id").agg(F.collect_set("trigram").alias("have"))
    kinds = F.array_compact(F.array(*[F.when(_holds(q, F.col("have")), F.lit(k)) for k, q in sorted(queries.items())]))
    return have.select("doc_id", kinds.alias("kinds")).filter(F.size("kinds") > 0)


KIND = "array<struct<start:int,at:int,end:int,kind:string>>"
#: Matches whose offsets are added up together: appending copies an array, so it is done in blocks.
BLOCK = 256


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, at, end, kind>> of the rule's secrets in the text, which has a match."""
    found = lambda group: F.transform(F.regexp_extract_all(text, F.lit(rule.scanned), F.lit(group)), F.length)
    whole = found(0)
    gaps = F.transform(F.slice(F.split(text, rule.scanned, -1), F.lit(1), F.size(whole)), F.length)
    part = F.arrays_zip(gaps.alias("g"), whole.alias("m"), *([found(rule.group).alias("p")] if rule.group else []), *([found(rule.lead).alias("l")] if rule.lead else []))
    none = F.expr(f"cast(array() as {KIND})")

    def step(acc: Column, x: Column) -> Column:
        lead = x["l"] if rule.lead else F.lit(0)
        a, b = acc["pos"] + x["g"], acc["pos"] + x["g"] + x["m"]
        one = F.struct((a + lead).alias("start"), F.lit(order).alias("at"), b.alias("end"), F.lit(rule.kind).alias("kind"))
        out = F.concat(acc["out"], F.array(one))
        return F.struct(b.alias("pos"), (F.when(x["p"] >= rule.least, out).otherwise(acc["out"]) if rule.group else F.when(x["m"] >= rule.least, out).otherwise(acc["out"])).alias("out"))

    def block(acc: Column, steps: Column) -> Column:
        inner = F.aggregate(steps, F.struct(acc["pos"].alias("pos"), none.alias("out")), step)
        # one evaluation of the inner sum: it travels as an element of an array
        return F.element_at(F.transform(F.array(inner), lambda x: F.struct(x["pos"].alias("pos"), F.concat(acc["out"], F.array(x["out"])).alias("out"))), 1)

    # the zipped arrays are bound once, by a transform over an array of one
    def blocks(parts: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int")), lambda b: F.slice(parts, b * BLOCK + 1, F.lit(BLOCK)))

    chunks = F.element_at(F.transform(F.array(part), blocks), 1)
    return F.flatten(F.aggregate(chunks, F.struct(F.lit(0).alias("pos"), F.expr(f"cast(array() as array<{KIND}>)").alias("out")), block, lambda acc: acc["out"]))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and `spans`, an array of (start, at, end, kind) sorted by start, then by rule."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q is not True}
    found = base
    if indexed:
        index = staged(postings(base, set().union(*map(trigrams, indexed.values()))), "postings")
        found = base.join(candidates(index, indexed), "doc_id", "left")
    none = F.expr(f"cast(array() as {KIND})")
    each = []
    for k, r in enumerate(rules):
        open_ = (F.array_contains("kinds", r.kind) | F.col("doc_id").isNull()) if r.kind in indexed else F.lit(True)
        each.append(F.when(open_ & F.col("text").rlike(r.scanned), _spans(F.col("text"), r, k)).otherwise(none))
    return found.select("doc_id", F.array_sort(F.concat(*each)).alias("spans"))


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The contract's columns from scan()."""
    bases = [r.kind for r in rules if r.base]
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(bases))
    return found.select("doc_id", *map(count, bases), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def sql(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for digest(scan(documents)): every rule scans every text."""
    quoted = lambda s: s.replace("'", "''")
    parts, names = [], []
    for k, r in enumerate(rules):
        pattern = quoted(r.pattern)
        parts.append(
            f"r{k} as (select doc_id, list_filter(list_transform(range(1, len(m) + 1), lambda i: {{'s': coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0)"
            f" + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0), 'k': {k}, 'l': length(m[i]), 'p': length(p[i]), 'n': '{r.kind}'}}), lambda x: x.p >= {r.least}) as f"
            f" from (select doc_id, rn, regexp_extract_all(t, '{pattern}', 0) as m, regexp_extract_all(t, '{pattern}', {r.group}) as p, string_split_regex(t, '{pattern}') as g from d) q where true)"
        )
        names.append(f"r{k}")
    parts = [p.replace("select doc_id, list_filter", "select doc_id, rn, list_filter") for p in parts]
    joined = " ".join(f"join {n} using (rn)" for n in names)
    bases = ", ".join(f"len({n}.f) as n_{r.kind}" for n, r in zip(names, rules, strict=True) if r.base)
    base = ", ".join(n + ".f" for n, r in zip(names, rules, strict=True) if r.base)
    more = ", ".join(n + ".f" for n in names)
    text = lambda x: f"array_to_string(list_transform(list_sort(flatten([{x}])), lambda x: x.n || ':' || cast(x.s as bigint) || ':' || cast(x.s + x.l as bigint)), ',')"
    return (
        "with d as (select doc_id, coalesce(text, '') as t, row_number() over () as rn from documents), "
        + ", ".join(parts)
        + f" select d.doc_id, {bases}, sha256({text(base)}) as base_sha256, {text(more)} as spans from d {joined}"
    )
