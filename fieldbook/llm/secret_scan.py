"""Secret scans through a trigram index, in DataFrame functions only.

`trigram_query` derives from each rule's regex which trigrams a match must hold: an AND over runs of
literals of an OR over their spellings of an AND of trigrams. `postings` is the inverted index over the
rules' trigrams: a row (trigram, document) for each one that stands in the document. `candidates`
intersects the postings, and `scan` verifies the candidates with the regexes. A rule that has no mandatory
trigram scans every document.

The index is in lower case, so its answer may hold too many documents, never too few. Postings
are keyed by 64 bits of a row's id and text: rows that share both (or, by chance, the bits) share their candidates, and each is
verified by itself. Lists of at most `SMALL` candidates (some 20 MB) go to every task, so that texts stay where they are; larger
ones are joined by a shuffle.

Places of matches are sums of the lengths before them. They are built in chunks of `CHUNK` matches, as are masked texts, since appending
to an array copies it: the work grows with the matches, not with their square.

Null and empty texts have no spans. Repeated rows each give a row. An empty table gives none. Spans are
[start, end) in code points, found in whole texts of any length.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from re import _constants as K  # the standard library's regex syntax tree
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.llm.common import saved

MOST_SPELLINGS, SMALL, CHUNK = 64, 500_000, 256


@dataclass(frozen=True)
class Rule:
    """A kind of secret: the regex, and the fewest characters of `group` that count."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base kinds in their order, then those that this scanner adds.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

#: An AND of ORs of ANDs of trigrams.
Query = list[list[frozenset[str]]]


def trigram_query(pattern: str) -> Query:
    """What any match of the pattern holds, in lower case; empty if nothing is mandatory."""
    query: Query = []

    def close(spellings: set[str]) -> None:
        if spellings and all(len(s) > 2 for s in spellings):
            every = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in spellings}
            query.append(sorted((a for a in every if not any(b < a for b in every)), key=sorted))

    def exact(tokens: list) -> set[str] | None:
        """All strings that the tokens match, if they are few."""
        out = {""}
        for op, arg in tokens:
            if op is K.LITERAL:
                more: set[str] | None = {chr(arg).lower()}
            elif op is K.IN and all(o is K.LITERAL for o, _ in arg):
                more = {chr(a).lower() for _, a in arg}
            elif op is K.SUBPATTERN:
                more = exact(list(arg[3]))
            elif op is K.BRANCH:
                parts = [exact(list(b)) for b in arg[1]]
                more = None if None in parts else set().union(*parts)
            elif op is K.MAX_REPEAT and arg[1] == 1:
                more = exact(list(arg[2]))
                more = None if more is None else more | {""} if arg[0] == 0 else more
            elif op is K.MAX_REPEAT and arg[0] == arg[1] and arg[0] < 9:
                more = exact(list(arg[2]) * arg[0])
            else:
                more = None
            if more is None or len(out) * len(more) > MOST_SPELLINGS:
                return None
            out = {a + b for a in out for b in more}
        return out

    def walk(tokens: list) -> None:
        run: set[str] = {""}
        for op, arg in tokens:
            more = exact([(op, arg)])
            if more is not None and len(run) * len(more) <= MOST_SPELLINGS:
                run = {a + b for a in run for b in more}
                continue
            close(run)
            run = {""}
            if more is not None:
                run = more
            elif op is K.SUBPATTERN:
                walk(list(arg[3]))
            elif op in (K.MAX_REPEAT, K.MIN_REPEAT) and arg[0] > 0:
                walk(list(arg[2]))
        close(run)

    walk(list(parser.parse(pattern)))
    return query


def trigrams(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({t for r in rules for any_of in trigram_query(r.pattern) for spelling in any_of for t in spelling})


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(id_col, text_col)


def postings(docs: DataFrame, words: list[str], id_col: str, text_col: str) -> DataFrame:
    """(key, trigram number) for each of the trigrams that stands in the text."""
    rows = docs.where(F.col(text_col).isNotNull()).select(row_key(id_col, text_col).alias("key"), F.lower(F.col(text_col)).alias("low"))  # lowered once for all trigrams
    held = F.array_compact(F.array(*[F.when(F.col("low").contains(t), F.lit(i)) for i, t in enumerate(words)]))
    return rows.select("key", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, words: list[str], rules: tuple[Rule, ...]) -> DataFrame:
    """key and, for each rule that has mandatory trigrams, whether the intersected postings hold the document."""
    number = {t: i for i, t in enumerate(words)}
    width = 62
    masks = [F.bit_or(F.when(F.floor(F.col("trigram") / width) == w, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.col("trigram"), F.lit(width)).cast("int"))).otherwise(F.lit(0).cast("bigint"))).alias(f"m{w}") for w in range(len(words) // width + 1)]

    def holds(spelling: frozenset[str]) -> Column:
        out = F.lit(True)
        for w in range(len(masks)):
            if need := sum(1 << number[t] % width for t in spelling if number[t] // width == w):
                out = out & (F.col(f"m{w}").bitwiseAND(F.lit(need).cast("bigint")) == need)
        return out

    def answer(query: Query) -> Column:
        out = F.lit(True)
        for any_of in query:
            one = F.lit(False)
            for spelling in any_of:
                one = one | holds(spelling)
            out = out & one
        return out

    asked = {r.kind: trigram_query(r.pattern) for r in rules}
    table = index.groupBy("key").agg(*masks).select("key", *[answer(q).alias(k) for k, q in asked.items() if q])
    return table.where(" or ".join(f"`{k}`" for k, q in asked.items() if q) or "false")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of the value, which is computed once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, end, kind) of the rule's matches, leftmost first, without overlap.

    Matches and the pieces between them alternate, so their lengths add up to the places.
    """
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    counted = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda g: F.length(g) >= rule.least)
    pieces = F.split(text, rule.pattern, -1)
    rows = F.zip_with(F.zip_with(found, counted, lambda m, ok: F.struct(F.length(m).alias("n"), ok.alias("ok"))), F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.length(p)), lambda m, gap: F.struct(m["n"].alias("n"), m["ok"].alias("ok"), gap.alias("gap")))
    kind = "array<struct<start:int,rank:int,end:int,kind:string,ok:boolean>>"

    def place(at: Column, m: Column) -> Column:
        start = at + m["gap"]
        return F.struct(start.alias("start"), F.lit(order).alias("rank"), (start + m["n"]).alias("end"), F.lit(rule.kind).alias("kind"), m["ok"].alias("ok"))

    def chunk(c: Column) -> Column:
        begin = F.struct(c["at"].alias("at"), F.array().cast(kind).alias("out"))
        return F.aggregate(c["rows"], begin, lambda acc, m: F.struct((acc["at"] + m["gap"] + m["n"]).alias("at"), F.array_append(acc["out"], place(acc["at"], m)).alias("out")), lambda acc: acc["out"])

    def placed(parts: Column) -> Column:
        lengths = F.transform(parts, lambda c: F.aggregate(c, F.lit(0), lambda a, m: a + m["gap"] + m["n"]))
        out = F.flatten(F.transform(F.zip_with(parts, before(lengths, lambda a, x: a + x), lambda c, at: F.struct(at.alias("at"), c.alias("rows"))), chunk))
        return F.transform(F.filter(out, lambda s: s["ok"]), lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"]))

    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    return let(rows, lambda r: F.when(F.size(r) == 0, none).otherwise(let(chunks(r), placed)))


def chunks(rows: Column) -> Column:
    """An array, not empty, cut into arrays of CHUNK elements."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / CHUNK).cast("int")), lambda i: F.slice(rows, i * CHUNK + 1, F.lit(CHUNK)))


def before(values: Column, plus: Callable[[Column, Column], Column]) -> Column:
    """What `plus` makes of 0 and all values before each one."""
    return F.aggregate(F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0))), F.array(F.lit(0)), lambda acc, x: F.array_append(acc, plus(F.element_at(acc, -1), x)))


def joined(found: Column) -> Column:
    """kind:start:end by start, then the rules' order, joined by commas."""
    return F.concat_ws(",", F.transform(F.array_sort(found), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def scan(docs: DataFrame, *, rules: tuple[Rule, ...] = BASE + MORE, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, row (a struct of no_text and the columns to keep) and an array of (start, rank, end, kind) for each rule, named by its kind, of each row."""
    words = trigrams(rules)
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct(F.col(text_col).isNull().alias("no_text"), *keep).alias("row"), row_key(id_col, text_col).alias("_row"))
    table = saved(candidates(postings(docs, words, id_col, text_col), words, rules))
    flags = [c for c in table.columns if c != "key"]
    table = table.select(F.col("key").alias("_key"), *[F.col(c).alias(f"_{c}") for c in flags])
    rows = own.join(F.broadcast(table) if table.count() <= SMALL else table, F.col("_row") == F.col("_key"), "left")
    cols = []
    for i, r in enumerate(rules):
        found = spans(F.col("text"), r, i)
        cols.append((F.when(F.coalesce(F.col(f"_{r.kind}"), F.lit(False)), found).otherwise(none) if r.kind in flags else F.when(F.col("text").rlike(r.pattern), found).otherwise(none)).alias(r.kind))
    return rows.select("doc_id", "text", "row", *cols)


def digests(found: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, from `scan`."""
    base = F.concat(*[F.col(r.kind) for r in BASE])
    return found.select(
        "doc_id",
        *[F.size(r.kind).cast("bigint").alias(f"n_{r.kind}") for r in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.concat(*[F.col(r.kind) for r in rules])).alias("spans"),
    )


def masked(found: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, mask: str = "[secret]") -> Column:
    """The text with each found span (overlapping ones as one) in its place masked."""
    text = F.col("text")

    def chunk(x: Column) -> Column:
        start = F.struct(F.lit("").alias("out"), x["at"].alias("at"))

        def step(acc: Column, s: Column) -> Column:
            fresh = F.concat(acc["out"], F.substring(x["piece"], acc["at"] - x["at"] + 1, s["start"] - acc["at"]), F.lit(mask))
            return F.struct(F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

        return F.aggregate(x["c"], start, step, lambda acc: acc["out"])

    def filled(both: Column) -> Column:
        # each chunk works on its own piece of the text: from the end of the spans before to the end of its own
        parts, ends = both["parts"], both["ends"]
        begun = F.zip_with(parts, before(ends, F.greatest), lambda c, at: F.struct(c.alias("c"), at.alias("at")))
        pieces = F.zip_with(begun, ends, lambda x, end: F.struct(x["c"].alias("c"), x["at"].alias("at"), F.substring(text, x["at"] + 1, F.greatest(end - x["at"], F.lit(0))).alias("piece")))
        return F.concat(F.array_join(F.transform(pieces, chunk), ""), F.substring(text, F.array_max(ends) + 1, F.length(text)))

    def cut(every: Column) -> Column:
        parts = lambda p: F.struct(p.alias("parts"), F.transform(p, lambda c: F.aggregate(c, F.lit(0), lambda a, s: F.greatest(a, s["end"]))).alias("ends"))
        return F.when(F.size(every) == 0, text).otherwise(let(let(chunks(every), parts), filled))

    return let(F.transform(F.array_sort(F.concat(*[F.col(r.kind) for r in rules])), lambda s: F.struct(s["start"], s["end"])), cut)
