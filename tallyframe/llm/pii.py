"""Personal data by candidate gradient boosting, in DataFrame functions only.

1. Generators propose spans with high recall: the four base patterns, looser ones beside them, and long tokens that
   may be secrets. Candidates of several generators may overlap.
2. Every candidate gets features of its format and of the text around it.
3. Boosted trees score candidates. They are trained on the driver from a bounded sample of the candidates that
   pass the kind's test on their digits, and become SQL expressions. Base spans are right; others are right or
   wrong by what stands around and inside them (``likely``), and ``EXAMPLES`` have labels given by hand, so
   that both classes are met in any corpus.
4. Per kind, the least score above which held-out looser candidates are nearly all right is the threshold.
   Base spans are always kept; another candidate is added if it passes the kind's test and the threshold and
   overlaps no base span. Added spans that overlap are joined into one, so that nothing selected stays readable.

Positions count code points; a match's place is the length of the pieces and matches before it, as
``split`` and ``regexp_extract_all`` walk a text alike. Every step takes time in proportion to the text: repeated
groups are possessive (Java matches these in a loop, others by recursion), matches are placed by sums over blocks,
and overlaps are found in sorted order.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

KINDS = ("email", "ip", "card", "phone")
#: Kinds that have no base pattern.
MORE_KINDS = ("secret",)
ALL_KINDS = KINDS + MORE_KINDS

#: Patterns equal in their matches to the ones of the contract, in forms that take linear time: a run of
#: name characters or digits is entered at its start only, and never twice.
LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
#: A run that holds digits with any separators; cut at doubled separators it gives the card pattern's matches.
DIGITS = r"[0-9][ 0-9-]{11,}[0-9]"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"

#: Looser generators: words for the signs of an address, spaced ones, any separators between digit groups, other
#: prefixes; tokens of 20 characters and more with a digit among them.
LOOSE = {
    "email": rf"(?i)(?<!{LOCAL}){LOCAL}++(?: ?[(\[{{]at[)\]}}] ?| @ | at |@)[A-Za-z0-9-]++(?:(?: ?[(\[{{]dot[)\]}}] ?| dot | \. |\.)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:(?: ?\. ?| ?\[\.\] ?| ?\(\.\) ?)[0-9]{1,3}+){3}(?![0-9.])",
    "card": r"(?<![0-9])[0-9]{4}+(?:(?:[ ./_-]{1,3}+[0-9]{4}+){3}|[ ./_-]{1,3}+[0-9]{6}+[ ./_-]{1,3}+[0-9]{5}+)(?![0-9])",
    "phone": r"(?<![0-9+])(?:00[1-9][0-9]{0,2}+[ .-]?(?:\([0-9]{1,4}+\)[ .-]?)?[0-9]{1,12}+|\([0-9]{2,5}+\)[ .-]?[0-9]{2,12}+)(?:[ .-][0-9]{2,6}+){0,5}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]{0,512}+[0-9])[A-Za-z0-9+/_-]{20,512}+(?![A-Za-z0-9+/_-])",
}
#: The base patterns for a whole span.
WHOLE = {
    "email": rf"^{LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++$",
    "ip": r"^[0-9]++(?:\.[0-9]++){3}$",
    "card": r"^[0-9]++(?:[ -][0-9]++){0,18}$",
}

#: Words that speak for each kind when they stand before a span.
CUES = {
    "email": "mail|contact|write",
    "ip": "ip|host|server|address",
    "card": "card|visa|credit|pay",
    "phone": "phone|tel|call|mobile|fax",
    "secret": "token|secret|password|passwd|pwd|api[ _-]?key|access[ _-]?key|auth|bearer|credential",
}
CONTEXT = 24

#: Candidates of each kind that the driver trains on, at most.
SAMPLE = 4000
TREES, RATE, DEPTH = 12, 0.3, 2
#: Share of held-out candidates above a threshold that must be right.
PRECISION = 0.98
#: Matches whose lengths are summed together.
BLOCK = 128
#: Added spans that a broadcast may hold.
BROADCAST_SPANS = 400_000

HITS = "array<struct<s:int,e:int,m:string,b:string,a:string>>"

#: Looser spans with labels given by hand: (right ones, wrong ones) of each kind, as what stands before and the span.
EXAMPLES = {
    "email": (
        ("write to |jane.roe (at) example (dot) org", "she is |bob(at)shop.example.com", "or |amy_lee [at] mail [dot] net", "mail: |kim{at}site{dot}com", "contact |tom at example dot com", "then |j.doe at example dot org", "mail |ann @ example . com", "see |r.fox @ mail . net", "it is |lee99(AT)home(DOT)edu"),
        ("we |look at www.example.com", "they |met at home dot com", "to |arrive at 10.30", "the |price at 5.99", "so |stay at home.Then", "he |was at www.site.org", "for |ten @ 4 . 50", "buy |two @ 3.x9", "then |stop at page.7"),
    ),
    "ip": (
        ("the |10[.]20[.]30[.]40", "from |192(.)168(.)0(.)7", "host |10 . 1 . 2 . 3", "server |172 .16 .0 .9", "address: |8. 8. 4. 4", "at |203[.]0[.]113[.]9", "ip |198. 51. 100. 7"),
        ("see |1. 2. 3. 4", "in |2 . 4 . 6 . 8", "items |10. 11. 12. 13", "then |5 .6 .7 .8", "steps |1. 20. 30. 40", "list |100. 101. 102. 103", "of |3. 14. 15. 92"),
    ),
    "card": (
        ("card |4111/1111/1111/1111", "pay |5500.0055.5555.5559", "it is |4111_1111_1111_1111", "visa: |4012.8888.8888.1881", "was |5555/5555/5555/4444", "amex |3782/822463/10005", "then |4111 - 1111 - 1111 - 1111", "credit |4012 8888/8888 1881"),
        ("part |0000/0000/0000/0000", "of |0111.1111.1111.1119", "id |1111_1111_1111_1117", "no |9111/1111/1111/1110", "row |8000.0000.0000.0003", "was |4111/1111.1111_1111", "ref |5500.0055/5555 - 5559", "set |7000/0000/0000/0005"),
    ),
    "phone": (
        ("call |(020) 7946 0958", "is |(0161) 496 0123", "or |(01632) 960123", "at |(603) 555-8791", "fax: |(212) 555.0123", "on |0044 20 7946 0958", "ring |001 603 555 8791", "tel |0049 30 123456", "phone |(91) 123 45 67", "is |0033 1 23 45 67 89", "to |(415)555-2671", "by |0044 (0)20 7946 0958"),
        ("in |(2019) 1234 5678", "sum |(12) 345 678 90", "of |(1999) 2000 2001", "set |(45) 1234567", "table |(17) 2020 2021 2022", "ref |(10) 100000 200000", "eq |(11) 222 333 444 555", "rows |(3000) 400 500"),
    ),
    "secret": (
        ('token = "|04dbebab91ab85687d33eeaaf9ac699e1188f962', "api_key: |Zx81kfP0qLmN27rTyUwVb3", "password=|h7Gk29sLqP0zXcV5bNmA1dF", "Bearer |eyJhbGciOiJIUzI1NiIsInR5cCI6", "key |9f86d081884c7d659a2feaa0c55ad015", "secret: |wJalrXUtnFEMI/K7MDENG/bPxRfiCY0", "is |e3b0c44298fc1c149afbf4c8996fb92427ae41e4"),
        ("see |chapter-10-section-4-paragraph-2", "file |2024/annual/reports/final", "the |one-two-three-four-five-6", "in |version_2_of_the_long_document", "path |home/user/projects/site2/index", "a |2019-2020-2021-2022-2023", "of |10000000000000000000000"),
    ),
}


# Expressions are SQL texts: one call parses each, where columns would take thousands of calls into the JVM.


def bound(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` as a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def placed(text: str, pattern: str, hits: str) -> str:
    """Matches of a pattern as an array of (s, e, m, b, a): start, end, text, and what stands before and after.

    ``hits`` are its matches' texts. The surroundings reach as far as the neighbouring matches at most. Ends are sums
    of lengths: within blocks, and of whole blocks before, so that no sum walks over all matches.
    """
    total = lambda c: f"aggregate({c}, 0, (x, y) -> x + y)"
    block = f"cast(i div {BLOCK} as int)"
    out = f"transform(own, (m, i) -> named_struct('s', ends[i] - length(m), 'e', ends[i], 'm', m, 'b', right(gaps[i], {CONTEXT}), 'a', left(gaps[i + 1], 1)))"
    out = bound(f"transform(lens, (x, i) -> before[{block}] + {total(f'slice(lens, {block} * {BLOCK} + 1, i % {BLOCK} + 1)')})", "ends", out)
    out = bound(f"transform(sums, (x, i) -> {total('slice(sums, 1, i)')})", "before", out)
    out = bound(f"transform(sequence(0, cast((size(lens) - 1) div {BLOCK} as int)), i -> {total(f'slice(lens, i * {BLOCK} + 1, {BLOCK})')})", "sums", out)
    out = bound("zip_with(slice(gaps, 1, size(own)), own, (g, h) -> length(g) + length(h))", "lens", out)
    out = bound(hits, "own", bound(f"split({text}, r'{pattern}', -1)", "gaps", out))
    return f"if(size({hits}) > 0, {out}, cast(array() as {HITS}))"


def digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def luhn(d: str) -> str:
    """Whether a string of digits has a right check digit: every second digit from the right counts twice."""
    add = f"(s, i) -> s + {bound(f'cast(substring({d}, -i, 1) as int)', 'x', 'if(i % 2 = 0, x * 2 - if(x > 4, 9, 0), x)')}"
    return f"aggregate(sequence(1, length({d})), 0, {add}) % 10 = 0"


def octets(m: str) -> str:
    """Whether all numbers in a text are 255 at most, whatever zeros they start with."""
    bare = f"transform(regexp_extract_all({m}, '[0-9]+', 0), p -> regexp_replace(p, '^0+(?=.)', ''))"
    return f"forall({bare}, p -> length(p) < 3 or (length(p) = 3 and p <= '255'))"


def card_pieces(runs: str) -> str:
    """Runs of digits and separators, cut where two separators meet, which the card pattern can't pass."""
    # A separator alone between digits becomes _, so that a piece is a run of one class of characters.
    inner = bound("regexp_replace(r.m, '(?<=[0-9])[ -](?=[0-9])', '_')", "j", placed("j", "[0-9_]+", "regexp_extract_all(j, '[0-9_]+', 0)"))
    piece = "named_struct('s', p.s + r.s, 'e', p.e + r.s, 'm', p.m, 'b', concat(r.b, p.b), 'a', concat(p.a, r.a))"
    return f"flatten(transform({runs}, r -> transform({inner}, p -> {piece})))"


def passes(kind: str, m: str) -> str:
    n = f"length({digits(m)})"
    if kind == "card":
        return f"if({n} between 13 and 19, {bound(digits(m), 'd', luhn('d'))}, false)"
    if kind == "phone":
        return f"{n} between 9 and 15"
    return octets(m) if kind == "ip" else "true"


def by_kind(of: dict[str, str]) -> str:
    """The expression of the row's kind."""
    return "case kind " + " ".join(f"when '{k}' then {x}" for k, x in of.items()) + " end"


#: Features of a candidate (kind, loose, m, b, a).
VALUES = {
    "length": "length(m)",
    "digits": "length(regexp_replace(m, '[^0-9]', ''))",
    "groups": "regexp_count(m, '[0-9]+')",
    "letters": "regexp_count(m, '[A-Za-z]')",
    "dots": "regexp_count(m, '[.]')",
    "seps": "regexp_count(m, '[_/()-]')",
    "spaces": "regexp_count(m, ' ')",
    "cue": by_kind({k: f"b rlike '(?i)(?:{c})[^A-Za-z0-9]*$'" for k, c in CUES.items()}),
    "edge": "cast(b rlike '[A-Za-z0-9]$' as int) + cast(a rlike '^[A-Za-z0-9]' as int)",
    "loose": "loose",
    "tail": "length(regexp_extract(m, '([A-Za-z]*)$', 1))",
    "marks": r"regexp_count(m, r'(?i)[(\[{](?:at|dot|[.])[)\]}]')",
    "worded": "regexp_count(m, '(?i) (?:at|dot) ')",
    "named": "m rlike '^[A-Za-z0-9]+[._%+0-9-]'",
    "kinds": "size(array_distinct(regexp_extract_all(m, '[^A-Za-z0-9]+', 0)))",
    "zeros": "length(regexp_extract(m, '^[(]?(0*)', 1))",
    "lead": "length(regexp_extract(m, '^[(]?([0-9]*)', 1))",
    "first": "coalesce(try_cast(substring(regexp_replace(m, '[^0-9]', ''), 1, 1) as int), -1)",
}
FEATURES = tuple(VALUES)
#: Whether a looser span that passes its kind's test is a right one, by its form and the text around it.
LIKELY = {
    "email": r"edge = 0 and tail between 2 and 24 and m rlike r'^[^@ (\[{]*[A-Za-z]' and case when marks > 0 or cue = 1 then true when worded = 0 then m rlike ' @ ' and not m rlike '[^ ][.][^ ]*$' else named = 1 end",
    "ip": "edge = 0 and (marks > 0 or cue = 1)",
    "card": "edge = 0 and first between 2 and 6 and (kinds = 1 or cue = 1)",
    "phone": "edge = 0 and (zeros = 2 or (zeros = 1 and digits between 9 and 11) or m rlike '^[(][2-9][0-9]{2}[)][ .-]?[2-9][0-9]{2}[ .-][0-9]{4}$' or cue = 1)",
    "secret": "(cue = 1 and letters > 0) or (m rlike '^[0-9a-f]+$' and length in (32, 40, 64) and letters > 4)",
}


def described(rows: DataFrame) -> DataFrame:
    """``rows`` (kind, loose, m, b, a) with their features and the weak label ``right``: base, or likely."""
    rows = rows.withColumns({f: F.expr(f"cast({v} as int)") for f, v in VALUES.items()})
    return rows.withColumn("right", F.expr(f"if(loose = 0, 1, cast(coalesce({by_kind(LIKELY)}, false) as int))"))


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's ``key`` (as key__) and all__, its candidates that pass their kind's test, those of base patterns with loose = 0."""
    patterns = {"email": EMAIL, "ip": IP, "card": DIGITS, "phone": PHONE} | {f"loose_{k}": p for k, p in LOOSE.items()}
    # What a text must hold for a pattern to match; cheaper than the pattern.
    digit = "text__ rlike '[0-9]'"
    guards = dict.fromkeys(patterns, digit) | {
        "email": "contains(text__, '@')",
        "loose_email": r"(contains(text__, '@') or text__ rlike r'(?i)[(\[{ ]at[)\]} ]')",
        "ip": f"contains(text__, '.') and {digit}",
        "phone": f"contains(text__, '+') and {digit}",
        "loose_phone": f"(contains(text__, '00') or contains(text__, '(')) and {digit}",
    }
    rows = docs.select(F.col(key).alias("key__"), F.coalesce(F.col(text), F.lit("")).alias("text__"))
    rows = rows.select("*", *[F.expr(f"if({guards[n]}, regexp_extract_all(text__, r'{p}', 0), cast(array() as array<string>))").alias(f"hits_{n}") for n, p in patterns.items()])
    rows = rows.select("key__", *[F.expr(placed("text__", p, f"hits_{n}")).alias(f"at_{n}") for n, p in patterns.items()])

    def of(kind: str, loose: int) -> str:
        at = f"at_loose_{kind}" if loose else card_pieces("at_card") if kind == "card" else f"at_{kind}"
        # What a base pattern matches whole is among its own candidates.
        other = f" and not v.m rlike r'{WHOLE[kind]}'" if loose and kind in WHOLE else ""
        return f"transform(filter({at}, v -> {passes(kind, 'v.m')}{other}), v -> named_struct('kind', '{kind}', 'loose', {loose}, 's', v.s, 'e', v.e, 'm', v.m, 'b', v.b, 'a', v.a))"

    every = [of(k, 0) for k in KINDS] + [of(k, 1) for k in LOOSE]
    return rows.select("key__", F.expr(f"concat({', '.join(every)})").alias("all__"))


def clear_of_base(rows: DataFrame) -> DataFrame:
    """``rows`` (id__, loose, s, e, …) with free: whether a looser span overlaps no base span of its text."""
    base = lambda c: F.when(F.col("loose") == 0, F.col(c))
    before = Window.partitionBy("id__").orderBy("s", "loose", "e").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("id__").orderBy(F.desc("s"), F.desc("loose"), F.desc("e")).rowsBetween(Window.unboundedPreceding, -1)
    over = (F.coalesce(F.max(base("e")).over(before), F.lit(0)) > F.col("s")) | (F.coalesce(F.min(base("s")).over(after), F.col("e")) < F.col("e"))
    return rows.withColumn("free", (F.col("loose") == 1) & ~over)


def joined_spans(rows: DataFrame) -> DataFrame:
    """Spans (id__, kind, s, e, score) of which none overlap: overlapping ones become one, of the best one's kind."""
    w = Window.partitionBy("id__").orderBy("s", "e", "kind")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new__", (F.coalesce(reach, F.lit(-1)) <= F.col("s")).cast("int"))
    rows = rows.withColumn("group__", F.sum("new__").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max(F.struct(F.col("score"), (-F.col("s")).alias("first"), F.col("kind"))).alias("best")
    return rows.groupBy("id__", "group__").agg(F.min("s").alias("s"), F.max("e").alias("e"), best).select("id__", "best.kind", "s", "e", "best.score")


# --- boosted trees, trained on the driver ---


def grow(rows: list[tuple], residual: list[float], weight: list[float], depth: int) -> tuple:
    """A regression tree as (feature, threshold, left, right) or ('leaf', value); left is at most the threshold."""
    g, h = sum(residual), sum(weight)
    leaf = ("leaf", g / (h + 1.0))
    if not depth or len(rows) < 8:
        return leaf
    best = None
    for f in range(len(rows[0])):
        by: dict[int, list[float]] = {}
        for x, r, w in zip(rows, residual, weight, strict=True):
            b = by.setdefault(x[f], [0.0, 0.0])
            b[0] += r
            b[1] += w
        left_g = left_h = 0.0
        for v in sorted(by)[:-1]:
            left_g += by[v][0]
            left_h += by[v][1]
            gain = left_g**2 / (left_h + 1.0) + (g - left_g) ** 2 / (h - left_h + 1.0) - g**2 / (h + 1.0)
            if gain > 1e-6 and (best is None or gain > best[0] + 1e-12):
                best = (gain, f, v)
    if best is None:
        return leaf
    _, f, v = best
    sides = []
    for low in (True, False):
        at = [i for i, x in enumerate(rows) if (x[f] <= v) == low]
        sides.append(grow([rows[i] for i in at], [residual[i] for i in at], [weight[i] for i in at], depth - 1))
    return (f, v, *sides)


def value(tree: tuple, x: tuple) -> float:
    while tree[0] != "leaf":
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree[1]


def boost(rows: list[tuple], labels: list[int]) -> tuple[float, list[tuple]]:
    """Log-odds of the labels' share and trees that add to it (logistic loss, second-order steps)."""
    share = (sum(labels) + 1.0) / (len(labels) + 2.0)
    base = math.log(share / (1 - share))
    scores, trees = [base] * len(rows), []
    for _ in range(TREES if 0 < sum(labels) < len(labels) else 0):
        p = [1 / (1 + math.exp(-s)) for s in scores]
        tree = grow(rows, [y - q for y, q in zip(labels, p, strict=True)], [q * (1 - q) for q in p], DEPTH)
        trees.append(tree)
        scores = [s + RATE * value(tree, x) for s, x in zip(scores, rows, strict=True)]
    return base, trees


def calibrated(scores: list[float], labels: list[int]) -> float:
    """The least score such that, at it and above, ``PRECISION`` of the labels are 1; infinite if there is none."""
    best, right = math.inf, 0
    ranked = sorted(zip(scores, labels, strict=True), key=lambda x: (-x[0], x[1]))
    for n, (s, y) in enumerate(ranked, 1):
        right += y
        if right >= PRECISION * n and (n == len(ranked) or ranked[n][0] < s):
            best = s
    return best


def tree_text(tree: tuple) -> str:
    """A tree as a SQL expression over the features."""
    if tree[0] == "leaf":
        return f"{float(tree[1])!r}D"
    f, v, low, high = tree
    return f"if({FEATURES[f]} <= {v}, {tree_text(low)}, {tree_text(high)})"


def examples(spark: SparkSession) -> dict[str, list[tuple[tuple, int]]]:
    """Features and label of each kind's ``EXAMPLES``, each between several surroundings."""
    texts, at = [], []
    for kind, sides in EXAMPLES.items():
        for label, side in zip((1, 0), sides, strict=True):
            for x in side:
                before, span = x.split("|")
                for start, end in (("", ""), ("Now ", " and more."), ("Well, all ", ", then\nthe rest")):
                    texts.append(start + before + span + end)
                    at.append((kind, len(start + before), len(start + before + span), label))
    # As one literal, not as rows from Python.
    rows = spark.range(1).select(F.posexplode(F.array(*[F.lit(t) for t in texts])).alias("doc_id", "text"))
    loose = candidates(rows).select("key__", F.explode(F.filter("all__", lambda x: x["loose"] == 1)).alias("x")).select("key__", "x.*")
    got = described(loose).select("key__", "kind", "s", "e", *FEATURES).collect()
    out: dict[str, list[tuple[tuple, int]]] = {k: [] for k in ALL_KINDS}
    for r in sorted(got):
        kind, s, e, label = at[r["key__"]]
        if r["kind"] == kind and r["s"] < e and s < r["e"]:
            out[kind].append((tuple(r[f] for f in FEATURES), label))
    return out


def sampled(rows: DataFrame, most: int) -> list:
    """Of each kind, base and looser, the rows of the ``most`` least hashes.

    Only hashes below a bound are collected, which lets about twice as many pass at any size of the input. Wholly equal
    rows have one hash and count once.
    """
    counts = {(r["kind"], r["loose"]): r["n"] for r in rows.groupBy("kind", "loose").agg(F.count("*").alias("n")).collect()}
    bounds = " ".join(f"when kind = '{k}' and loose = {i} then {min(1.0, 2 * most / n)!r}D" for (k, i), n in counts.items())
    if not bounds:
        return []
    got = rows.where(F.expr(f"shiftrightunsigned(h, 12) / {float(1 << 52)!r}D <= case {bounds} end")).dropDuplicates(["kind", "loose", "h"]).select("kind", "loose", "h", "m", "b", "a")
    got = described(got).select("kind", F.shiftrightunsigned("h", 12).alias("place"), "right", *FEATURES).collect()
    out: dict[tuple, list] = {}
    for r in sorted(got, key=lambda r: r["place"]):
        out.setdefault((r["kind"], r["loose"]), []).append(r)
    return [r for part in out.values() for r in part[:most]]


def fit(found: DataFrame, free: DataFrame) -> dict[str, tuple[float, list[tuple], float]]:
    """Base score, trees and threshold of each kind, from ``EXAMPLES`` and ``SAMPLE`` candidates of it at most.

    ``found`` has all candidates by row, ``free`` the looser ones that clear base spans. The sample is the least
    hashes of the candidates and their places, the same at every run, half of it at most base spans and half looser
    ones. A third is held out, and its looser ones give the threshold.
    """
    base = found.select("key__", F.explode(F.filter("all__", lambda x: x["loose"] == 0)).alias("x")).select("key__", "x.*")
    names = ("kind", "loose", "m", "b", "a", F.xxhash64("key__", "kind", "s", "e", "loose", "m", "b").alias("h"))
    got = sampled(base.select(*names).unionByName(free.select(*names)), SAMPLE // 2)
    given = examples(found.sparkSession)
    loose = FEATURES.index("loose")
    models = {}
    for kind in ALL_KINDS:
        data = given[kind] + [(tuple(r[f] for f in FEATURES), r["right"]) for r in got if r["kind"] == kind]
        train = [d for i, d in enumerate(data) if i % 3]
        held = [d for i, d in enumerate(data) if not i % 3 and d[0][loose]]
        start, trees = boost([x for x, _ in train], [y for _, y in train])
        scores = [start + RATE * sum(value(t, x) for t in trees) for x, _ in held]
        models[kind] = (start, trees, calibrated(scores, [y for _, y in held]))
    return models


def selected(free: DataFrame, models: dict[str, tuple[float, list[tuple], float]]) -> DataFrame:
    """Looser spans (id__, kind, s, e, score) that their kind's trees score at its threshold or above."""
    models = {k: x for k, x in models.items() if not math.isinf(x[2])}
    if not models:
        return free.select("id__", "kind", "s", "e", F.lit(0.0).alias("score")).where("false")
    sums = {k: " + ".join([f"{start!r}D", *[f"{RATE}D * {tree_text(t)}" for t in trees]]) for k, (start, trees, _) in models.items()}
    # Rounding must not part what the driver summed from what the executors sum.
    least = {k: f"{x[2] - 1e-9!r}D" for k, x in models.items()}
    rows = described(free).withColumn("total", F.expr(by_kind(sums))).where(F.expr(f"total >= {by_kind(least)}"))
    return joined_spans(rows.select("id__", "kind", "s", "e", F.expr("1D / (1D + exp(-total))").alias("score")))


def find_personal_data(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", models: dict | None = None) -> DataFrame:
    """Personal data of every row.

    Returns ``key``, n_email, n_ip, n_card, n_phone (base spans), base_sha256 (of the base spans as
    kind:start:end by kind and start, comma-joined), spans (base and added ones, joined likewise), n_secret and
    secrets (tokens that the model takes for secrets, joined likewise), n_private (all of these) and
    redactions (an array of kind, s, e, score; base spans score 1).

    ``models`` replaces the trees that are trained here. Null texts count as empty and have no spans; repeated
    rows and null keys are kept, equal rows with equal results; extra columns aren't read; an empty table gives no rows.
    Base matches are leftmost, so they have no ties; an added span that ties with another in score and start takes
    the later kind's name. Texts of any length are searched whole: only one text's candidates must fit into a task.
    """
    found = stored(spark, candidates(docs, key, text).withColumn("id__", F.monotonically_increasing_id()), "pii")
    some = found.where(F.exists("all__", lambda x: x["loose"] == 1)).select("id__", "key__", F.explode("all__").alias("x")).select("id__", "key__", "x.*")
    free = stored(spark, clear_of_base(some).where("free").drop("free"), "pii-free")
    models = models or fit(found, free)
    added = stored(spark, selected(free, models), "pii-added")
    n = added.count()
    added = added.groupBy("id__").agg(F.collect_list(F.struct("kind", "s", "e", "score")).alias("added"))
    added = F.broadcast(added) if n <= BROADCAST_SPANS else added

    rank = f"array_position(array({', '.join(repr(k) for k in ALL_KINDS)}), x.kind)"
    span = lambda c, score: f"transform({c}, x -> named_struct('rank', {rank}, 's', x.s, 'e', x.e, 'kind', x.kind, 'score', {score}))"
    base = F.expr(f"array_sort({span('filter(all__, x -> x.loose = 0)', '1D')})")
    rows = found.select("id__", "key__", base.alias("base")).join(added, "id__", "left")
    rows = rows.withColumn("all", F.expr(f"if(added is null, base, array_sort(concat(base, {span('added', 'x.score')})))"))
    joined = lambda c: f"array_join(transform({c}, x -> concat_ws(':', x.kind, cast(x.s as string), cast(x.e as string))), ',')"
    known, secrets = "filter(all, x -> x.kind <> 'secret')", "filter(all, x -> x.kind = 'secret')"
    return rows.select(
        F.col("key__").alias(key),
        *[F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS],
        F.expr(f"sha2({joined('base')}, 256)").alias("base_sha256"),
        F.expr(joined(known)).alias("spans"),
        F.expr(f"cast(size({secrets}) as long)").alias("n_secret"),
        F.expr(joined(secrets)).alias("secrets"),
        F.expr("cast(size(all) as long)").alias("n_private"),
        F.expr("transform(all, x -> named_struct('kind', x.kind, 's', x.s, 'e', x.e, 'score', x.score))").alias("redactions"),
    )


def op6_boosted_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents."""
    return find_personal_data(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("redactions")
