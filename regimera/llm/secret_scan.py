"""Secret scan with corpus-wide ownership frequency.

Every text is searched for three base kinds (assign, access, hex) and for generic candidates: JSON web tokens, passwords in
URLs, private-key blocks, and runs of letters, digits and + / _ = - with a core of 16 letters and digits of both sorts. A
candidate is the hash of its value (of an assignment the value alone). Over the whole corpus each candidate's distinct
repositories and owners are counted: what many of the corpus's owners or repositories carry is an example copied from a
manual, what a small share of both carries is a live-looking credential of its owner. Base spans always stay. Each candidate
value, of a base kind or generic, that belongs to few becomes a span of kind `owned` over the value; a generic candidate
that overlaps a base span is none. "Few" is one, or `share` of the corpus's owners (and likewise of its repositories).

Matches are leftmost and non-overlapping for each kind; offsets count code points, ends are exclusive. They are
computed without Python: the gaps between matches (split) and the matches themselves (regexp_extract_all) give the
positions by running sums in blocks of BLOCK matches, so the work for a text is in proportion to its matches.

Scale: texts are never shuffled. Rows of candidates are, one for each (value, owner, repository) and task when they are
counted, and one for each (value, input partition) with its rows' numbers when verdicts are joined back, so a value that
a third of all rows hold is a row for each partition. Owners and repositories of the corpus are two counts in one row.

Cases: a null text is scanned as an empty one (no spans, the empty string's digest); repeated rows are reported each, and
count once for their owner; a null owner or repository counts as one; an empty table gives an empty result; a span
list may be arbitrarily long; ties on the start are listed by kind, then end; extra columns of any name are kept in a struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialise

#: The base patterns, in the order in which ties on the start are listed, and their least lengths.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]+)"
KINDS = (("assign", ASSIGN, 6), ("access", ACCESS, 20), ("hex", HEX, 24))
HEX_LONG = r"([0-9a-f]{24,})"  # the same matches as HEX with 24 characters or more, found faster
ACCESS_LONG = r"(AKIA[A-Z0-9]{16,})"  # likewise: 4 + 16 characters
#: A web token; a password in a URL; a private key; any long run of key characters.
GENERIC = (
    r"(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]+)?|://[A-Za-z0-9._%+-]+:[^\x20\x09-\x0D/:@]{6,}@"
    r"|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]+-----END|[A-Za-z0-9+/_=-]{16,})"
)
#: A bare run of key characters is a candidate with a core like this and so many digits and letters.
CORE = "[A-Za-z0-9]{16}"
GENERIC_DIGITS, GENERIC_LETTERS = 3, 3
#: Candidates of up to this share of the corpus's owners, and of its repositories, belong to few.
SHARE = 0.1
BLOCK = 128
OWNED = len(KINDS) + 1
_SPAN = "array<struct<start:int,rank:int,end:int,size:int,value:bigint>>"


def scan_before(items: Column, zero: Column, add) -> Column:
    """For each item of an array, add() over all items before it; blocks of BLOCK items keep the copying linear."""

    def from_(blocks: Column) -> Column:
        folded = F.transform(blocks, lambda b: F.aggregate(b, zero, add))

        def heads(sums: Column) -> Column:
            empty = F.struct(zero.alias("at"), F.array_repeat(zero, 0).alias("out"))
            # add() takes items; whole blocks are joined by the same operation on their results.
            step = lambda a, s: F.struct(add.join(a["at"], s).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
            return F.aggregate(sums, empty, step, lambda a: a["out"])

        def inside(first: Column) -> Column:
            def run(b: Column, i: Column) -> Column:
                empty = F.struct(F.get(first, i).alias("at"), F.array_repeat(zero, 0).alias("out"))
                step = lambda a, x: F.struct(add(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
                return F.aggregate(b, empty, step, lambda a: a["out"])

            return F.flatten(F.transform(blocks, run))

        return let(let(folded, heads), inside)

    return let(in_blocks(items), from_)


def in_blocks(items: Column) -> Column:
    """The array cut into arrays of BLOCK items; none of an empty one."""
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda b: F.slice(x, b * BLOCK + 1, BLOCK))
    return let(items, lambda x: F.when(F.size(x) > 0, cut(x)).otherwise(F.transform(F.array_repeat(F.lit(0), 0), lambda b: F.slice(x, 1, BLOCK))))


class _Plus:
    """Sum of lengths: an item is a number."""

    def __call__(self, a: Column, x: Column) -> Column:
        return a + x

    join = __call__


class _Furthest:
    """Greatest end of the base spans so far."""

    def __init__(self, below: int):
        self.below = below

    def __call__(self, a: Column, x: Column) -> Column:
        return F.when(x["rank"] < self.below, F.greatest(a, x["end"])).otherwise(a)

    def join(self, a: Column, b: Column) -> Column:
        return F.greatest(a, b)


def _spans(t: Column, pattern: str, rank: int, least: int, may: Column, value_test=None) -> Column:
    """Array of (start, rank, end, size, value): matches of pattern whose group 1, of `size` characters, has at least `least`."""

    def run(x: Column) -> Column:
        steps = F.transform(x["whole"], lambda m, i: F.length(F.get(x["gap"], i)) + F.length(m))

        def place(ahead: Column) -> Column:
            def one(v: Column, i: Column) -> Column:
                begin = F.get(ahead, i) + F.length(F.get(x["gap"], i))
                ok = F.length(v) >= least
                if value_test is not None:
                    ok = ok & value_test(v)
                found = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), (begin + F.length(F.get(x["whole"], i))).alias("end"), F.length(v).alias("size"), F.xxhash64(v).alias("value"))
                return F.when(ok, found)

            return F.filter(F.transform(x["value"], one), lambda s: s.isNotNull())

        return let(scan_before(steps, F.lit(0), _Plus()), place)

    parts = F.struct(
        F.split(t, pattern, -1).alias("gap"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("whole"), F.regexp_extract_all(t, F.lit(pattern), F.lit(1)).alias("value")
    )
    return F.when(may & t.rlike(pattern), let(parts, run)).otherwise(F.array().cast(_SPAN))


def _mixed(v: Column) -> Column:
    """A marked candidate, or a bare run with a core and enough digits and letters."""
    digits = F.length(v) - F.length(F.translate(v, "0123456789", ""))
    marks = F.length(v) - F.length(F.translate(v, "+/_=-", ""))
    letters = F.length(v) - digits - marks
    bare = (digits >= GENERIC_DIGITS) & (letters >= GENERIC_LETTERS) & v.rlike(CORE)
    return bare | v.startswith("://") | v.startswith("-----BEGIN ") | v.rlike(r"^eyJ[^.]+\.")


def candidates(text: Column) -> tuple[Column, Column]:
    """Base spans by start, then kind, and generic spans."""
    t = F.coalesce(text, F.lit(""))
    signs = t.contains("=") | t.contains(":")
    base = F.array_sort(
        F.concat(
            _spans(t, ASSIGN, 0, 6, signs),
            _spans(t, ACCESS_LONG, 1, 20, t.contains("AKIA")),
            _spans(t, HEX_LONG, 2, 24, F.lit(True)),
        )
    )
    return base, _spans(t, GENERIC, len(KINDS), 8, F.lit(True), _mixed)


def _free(base: Column, generic: Column) -> Column:
    """Generic spans that overlap no base span: none before reaches into them, the next one starts behind them."""

    def judge(every: Column) -> Column:
        # The next base span's start, looked up from behind: the same scan over the reversed list, with positions negated.
        turned = F.reverse(F.transform(every, lambda s: F.struct(s["rank"].alias("rank"), (-s["start"]).alias("end"))))
        reach = scan_before(every, F.lit(0), _Furthest(len(KINDS)))
        behind = F.reverse(scan_before(turned, F.lit(-(1 << 31) + 1), _Furthest(len(KINDS))))

        def keep(x: Column) -> Column:
            ok = lambda s, i: (s["rank"] == len(KINDS)) & (F.get(x["reach"], i) <= s["start"]) & (-F.get(x["behind"], i) >= s["end"])
            return F.filter(every, ok)

        return let(F.struct(reach.alias("reach"), behind.alias("behind")), keep)

    some = (F.size(base) > 0) & (F.size(generic) > 0)
    return F.when(some, let(F.array_sort(F.concat(base, generic)), judge)).otherwise(generic)


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*(k for k, _, _ in KINDS), "generic", "owned")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _values(every: Column) -> Column:
    """Spans of kind `owned` over the values of candidates, by start; a value that two kinds found at one place is one span."""
    of = F.transform(every, lambda s: F.struct((s["end"] - s["size"]).alias("start"), F.lit(OWNED).alias("rank"), s["end"].alias("end"), s["size"].alias("size"), s["value"].alias("value")))
    return let(F.array_sort(of), lambda v: F.filter(v, lambda s, i: (i == 0) | (F.get(v, i - 1) != s)))


def _found(docs: DataFrame, keep: list[str], owner: str, repository: tuple[str, ...], name: str) -> DataFrame:
    """(row, rid, owner, repository, base, generic), written: searching again in each branch makes code too large for the compiler."""
    base, generic = candidates(F.col("text"))
    rows = docs.select(
        F.struct(*keep).alias("row"),
        F.coalesce(F.concat(F.lit("s"), F.col(owner).cast("string")), F.lit("n")).alias("owner"),
        F.xxhash64(*[F.coalesce(F.concat(F.lit("s"), F.col(c).cast("string")), F.lit("n")) for c in repository]).alias("repository"),
        base.alias("base"), generic.alias("generic"),
    )
    return materialise(rows.withColumn("generic", _free(F.col("base"), F.col("generic"))).withColumn("rid", F.monotonically_increasing_id()), name)


def verdicts(rows: DataFrame, share: float = SHARE) -> DataFrame:
    """(value, owners, repositories, live) of every candidate value, from (owner, repository, base, generic)."""
    carried = rows.select("owner", "repository", F.explode(F.concat("base", "generic")).alias("span")).select(F.col("span.value").alias("value"), "owner", "repository").distinct()
    tally = carried.groupBy("value").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories"))
    known = rows.select("owner", "repository").distinct().agg(F.count_distinct("owner").alias("_o"), F.count_distinct("repository").alias("_r"))
    few = lambda n, of: F.col(n) <= F.greatest(F.lit(1), F.floor(F.lit(share) * F.col(of)))
    judged = tally.crossJoin(F.broadcast(known))  # one row
    return judged.select("value", "owners", "repositories", (few("owners", "_o") & few("repositories", "_r")).alias("live"))


def _live_spans(rows: DataFrame, spans: Column, share: float) -> DataFrame:
    """(rid, owned): the spans of each row, of those given, whose values belong to few. A value is joined once for each input partition."""
    held = rows.where(F.size("base") + F.size("generic") > 0).select("rid", F.explode(spans).alias("span"))
    packed = held.groupBy(F.col("span.value").alias("value"), F.shiftright("rid", 33).alias("part")).agg(F.collect_list(F.struct("rid", "span")).alias("spans"))
    hits = packed.join(verdicts(rows, share).where("live").select("value"), "value").select(F.inline("spans"))
    return hits.groupBy("rid").agg(F.array_sort(F.collect_list("span")).alias("owned"))


def scan(docs: DataFrame, keep: list[str], owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), share: float = SHARE) -> DataFrame:
    """Columns `keep` of docs with n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example and found (the spans as structs)."""
    rows = _found(docs, keep, owner, repository, "secret-spans")
    every = F.concat("base", "generic")
    empty = F.array().cast(_SPAN)
    some = rows.where(F.size(every) > 0).join(_live_spans(rows, _values(every), share), "rid", "left")
    some = some.select("row", "base", F.coalesce("owned", empty).alias("owned"), F.size(_values(every)).alias("n_values"))
    both = some.unionByName(rows.where(F.size(every) == 0).select("row", "base", empty.alias("owned"), F.lit(0).alias("n_values")))

    def count(rank: int) -> Column:
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")

    found = F.array_sort(F.concat("base", "owned"))
    return both.select(
        "row.*",
        count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _listed(found).alias("spans"),
        F.size("owned").cast("long").alias("n_live"), (F.col("n_values") - F.size("owned")).cast("long").alias("n_example"), found.alias("found"),
    )


def _cut(text: Column, spans: Column, mark: str) -> Column:
    """text without the union of the sorted spans, `mark` in place of each stretch. Pieces are taken from blocks of the text."""

    def run(every: Column) -> Column:
        reach = scan_before(every, F.lit(0), _Furthest(OWNED + 1))

        def pieces(at: Column) -> Column:
            gaps = F.filter(F.transform(every, lambda s, i: F.struct(F.get(at, i).alias("from"), s["start"].alias("to"))), lambda g: g["from"] <= g["to"])

            def block(b: Column) -> Column:
                first = F.get(b, 0)["from"]
                part = F.substring(text, first + 1, F.element_at(b, -1)["to"] - first)
                return let(part, lambda p: F.transform(b, lambda g: F.concat(F.substring(p, g["from"] - first + 1, g["to"] - g["from"]), F.lit(mark))))

            return F.flatten(F.transform(in_blocks(gaps), block))

        last = F.array_max(F.transform(every, lambda s: s["end"]))
        tail = let(last, lambda e: F.substring(text, e + 1, F.length(text)))
        return F.concat(F.array_join(let(reach, pieces), ""), tail)

    return F.when(F.size(spans) > 0, let(F.array_sort(spans), run)).otherwise(text)


def redact(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), share: float = SHARE, mark: str = "[secret]") -> DataFrame:
    """docs with every base span and every generic candidate that belongs to few replaced by `mark`; n_chars follows where it exists.

    Only rows that hold generic candidates meet verdicts, by row number; a null text stays null; columns are those of docs.
    """
    cols = docs.columns
    rows = _found(docs, cols, owner, repository, "secret-rows")
    more = _live_spans(rows, F.col("generic"), share)
    hit = rows.where(F.size("generic") > 0).join(more, "rid", "left").select("row", F.concat("base", F.coalesce("owned", F.array().cast(_SPAN))).alias("cut"))
    rest = rows.where(F.size("generic") == 0).select("row", F.col("base").alias("cut"))
    every = hit.unionByName(rest).withColumn("text", F.col("row.text"))
    done = every.select("row", _cut(F.col("text"), F.col("cut"), mark).alias("clean"))
    new = {"text": F.col("clean"), "n_chars": F.when(F.col("clean").isNull(), F.col("row.n_chars")).otherwise(F.length("clean").cast("long"))} if "n_chars" in cols else {"text": F.col("clean")}
    return done.select(*[new.get(c, F.col("row")[c]).alias(c) for c in cols])
