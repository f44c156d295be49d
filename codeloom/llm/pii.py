"""Personal data by weak supervision, in DataFrame functions only.

Four rules give the base spans. Around them, candidates are gathered that the rules reject or can't see (obfuscated
addresses, numbers without a country code, numbers that fail a checksum). Labelers vote on every candidate: the rule,
a gazetteer, the words before it, and its shape. Expectation-maximisation over the counts of vote patterns estimates
how reliable each labeler is; the posteriors train a logistic span classifier over votes and surroundings, which
decides on the candidates. Base spans stay whatever it says.

The driver sees counts of patterns alone, whose number is bounded by the number of votes and features.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm import _common as C

KINDS = ("email", "ip", "card", "phone")
#: Possessive forms of the rules: with nothing after the repeated part they match the same spans, without recursion,
#: and a run of name characters or digits is tried from its start alone.
RULES = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,63}(?: ?(?:[(\[]dot[)\]]|\.) ?[A-Za-z0-9-]{1,63}){1,8}",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?|(?<![0-9+.-]))(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.-])",
}
_BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?"
_ADDRESS = rf"^(?=[0-9]){_BYTE}(?:\.(?=[0-9]){_BYTE}){{3}}$"
#: Gazetteers: top-level domains, card issuers' leading digits, country codes.
DOMAINS = "com|org|net|edu|gov|int|info|biz|io|dev|app|eu|uk|de|fr|es|it|nl|pl|pt|se|ch|at|be|us|ca|mx|br|ar|cn|jp|in|au|ru"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
COUNTRIES = r"^\+?(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
NEAR = 24
FOR = {
    "email": r"(?i)(?:mail|contact|write|schreib|courri|correo|escrib)",
    "ip": r"(?i)(?:\bip\b|address|host|server|adress|direcci)",
    "card": r"(?i)(?:card|visa|master|credit|karte|carte|tarjeta)",
    "phone": r"(?i)(?:phone|\btel|call|mobile|\bfax|telefon|rufen|appel|llam)",
}
AGAINST = r"(?i)(?:version|section|licen[sc]e|token|sha|hash|isbn|\bid\b|0x)"
SMOOTHING = 1.0
ROUNDS = 60
#: Share of true spans that estimation starts from, and probability from which a candidate is reported.
START = 0.5
LEAST = 0.9
#: Items that running results are collected in at a time, and characters of a slab that pieces of text are taken from.
BLOCK = 256
SLAB = 4096


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    value = lambda i: F.substring(digits, (F.length(digits) - i).cast("int"), F.lit(1)).cast("int")
    twice = lambda i: F.when(i % 2 == 1, (value(i) * 2) % 10 + F.floor(value(i) * 2 / 10)).otherwise(value(i))
    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0).cast("long"), lambda a, i: a + twice(i).cast("long"))
    return F.when(F.length(digits) > 0, total % 10 == 0).otherwise(F.lit(False))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(items: Column, kind: str, step: Callable[[Column, Column], Column], start: Column) -> Column:
    """What step gives over each item and those before it, as an array of `kind`. Results are collected in blocks of
    BLOCK and the blocks' ends among themselves, so that the cost doesn't grow with the square of a long array."""
    empty = F.array().cast(f"array<{kind}>")
    zero = F.struct(start.cast(kind).alias("at"), empty.alias("out"))

    def grow(a: Column, x: Column) -> Column:
        return _let(step(a["at"], x).cast(kind), lambda at: F.struct(at.alias("at"), F.concat(a["out"], F.array(at)).alias("out")))

    def sums(part: Column) -> Column:
        return F.aggregate(part, zero, grow, lambda a: a["out"])

    def blocked(all_: Column) -> Column:
        last = F.floor((F.size(all_) - 1) / BLOCK).cast("int")
        block = lambda i: F.transform(F.sequence(i * BLOCK, F.least((i + 1) * BLOCK, F.size(all_)) - 1), lambda j: F.get(all_, j))
        return _let(F.transform(F.sequence(F.lit(0), last), lambda i: sums(block(i))), joined)

    def joined(blocks: Column) -> Column:
        ends = sums(F.transform(blocks, lambda x: F.element_at(x, -1)))
        return _let(ends, lambda e: F.flatten(F.transform(blocks, lambda x, i: F.when(i == 0, x).otherwise(F.transform(x, lambda v: step(F.get(e, i - 1), v).cast(kind))))))

    return F.when(F.size(items) > 0, _let(items, blocked)).otherwise(empty)


def _add(a: Column, x: Column) -> Column:
    return a + x


def located(text: Column, pattern: str) -> Column:
    """Array of (start, end, m, before, after) of the leftmost matches that don't overlap: places in code points, and
    the text's last NEAR characters before the match and the first one after it, as far as the neighbouring matches
    leave them (where two matches touch, the last and the first character of the other). The pieces between the
    matches and the matches themselves add up to their places, so nothing looks for a place in the whole text."""
    found = F.arrays_zip(F.split(text, pattern, -1).alias("s"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def spans(pieces: Column) -> Column:
        ends = running(F.transform(pieces, lambda x: F.length(x["s"]) + F.coalesce(F.length(x["m"]), F.lit(0))), "int", _add, F.lit(0))

        def span(x: Column, i: Column, e: Column) -> Column:
            behind, ahead = F.get(pieces, i - 1), F.get(pieces, i + 1)
            before = F.when(x["s"] != "", F.right(x["s"], F.lit(NEAR))).otherwise(F.coalesce(F.right(behind["m"], F.lit(1)), F.lit("")))
            after = F.when(ahead["s"] != "", F.left(ahead["s"], F.lit(1))).otherwise(F.coalesce(F.left(ahead["m"], F.lit(1)), F.lit("")))
            return F.struct((F.get(e, i) - F.length(x["m"])).alias("start"), F.get(e, i).alias("end"), x["m"].alias("m"), before.alias("before"), after.alias("after"))

        made = _let(ends, lambda e: F.transform(pieces, lambda x, i: span(x, i, e)))
        return F.filter(made, lambda x: x["m"].isNotNull())

    return _let(found, spans)


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(_ADDRESS)
    if kind == "card":
        digits = F.regexp_replace(m, "[ -]", "")
        return F.length(digits).between(13, 19) & luhn(digits)
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def _votes(kind: str, rule: Column, m: Column, before: Column) -> list[Column]:
    """Votes of the rule, the gazetteer, the words before and the shape: 1 for, -1 against, 0 nothing to say."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "email":
        gazetteer = F.when(m.rlike(rf"(?i)[.)\] ](?:{DOMAINS})$"), 1).otherwise(-1)
        shape = F.when(m.rlike(r"^[A-Za-z0-9]"), 1).otherwise(0)
    elif kind == "ip":
        gazetteer = F.when(m.rlike(r"^(?:0|255)\."), -1).otherwise(0)
        shape = F.when(m.rlike(r"(?:^|\.)0[0-9]"), -1).otherwise(1)
    elif kind == "card":
        gazetteer = F.when(digits.rlike(ISSUERS), 1).otherwise(-1)
        shape = F.when(m.rlike(r"^(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7})$"), 1).otherwise(-1)
    else:
        gazetteer = F.when(m.startswith("+"), F.when(m.rlike(COUNTRIES), 1).otherwise(-1)).otherwise(0)
        shape = F.when(m.rlike(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$"), 1).otherwise(0)
    context = F.when(before.rlike(AGAINST), -1).when(before.rlike(FOR[kind]), 1).otherwise(0)
    return [rule, gazetteer, context, shape]


def _candidates(text: Column, kind: str, place: int) -> Column:
    """Array of candidates of one kind; `base` marks the spans of the rule."""

    def candidate(x: Column, base: Column, rule: Column) -> Column:
        before = x["before"]
        votes = [v.cast("int").alias(f"v{i}") for i, v in enumerate(_votes(kind, rule, x["m"], before))]
        joined = before.rlike(r"[\p{L}\p{N}]$").cast("int") + 2 * x["after"].rlike(r"^[\p{L}\p{N}]").cast("int")
        quoted = before.rlike(r"[\"'=/#]\s?$").cast("int")
        return F.struct(F.lit(place).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), base.alias("base"), *votes, joined.alias("joined"), quoted.alias("quoted"))

    found = located(text, RULES[kind])
    wide = F.filter(found, lambda x: F.length(F.regexp_replace(x["m"], "[^0-9]", "")) >= 13) if kind == "card" else found
    made = F.transform(wide, lambda x: candidate(x, _valid(kind, x["m"]), F.when(_valid(kind, x["m"]), 1).otherwise(-1)))
    made = F.when(_worth(text, kind), made)
    if kind in LOOSE:
        loose = F.transform(located(text, LOOSE[kind]), lambda x: candidate(x, F.lit(False), F.lit(0)))
        worth = text.contains("(at)") | text.contains("[at]") if kind == "email" else text.rlike("[0-9]{3}")
        made = F.concat(_or_none(made), _or_none(F.when(worth, loose)))
    return _or_none(made)


CANDIDATE = "array<struct<kind:int,start:int,end:int,base:boolean,v0:int,v1:int,v2:int,v3:int,joined:int,quoted:int>>"
FEATURES = ("v0", "v1", "v2", "v3", "joined", "quoted")


def _or_none(x: Column) -> Column:
    return F.coalesce(x.cast(CANDIDATE), F.array().cast(CANDIDATE))


def _worth(text: Column, kind: str) -> Column:
    """A quick look that spares most texts the pattern."""
    return {"email": text.contains("@"), "phone": text.contains("+"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9]")}[kind]


def candidates(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (None: all) and the array column __pii of candidates, written to the shared folder."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.concat(*(_candidates(text, k, i) for i, k in enumerate(KINDS))).alias("__pii")
    return C.cut(docs.select(*(docs.columns if keep is None else keep), found), "pii")


def reliabilities(patterns: dict[tuple, int]) -> tuple[float, list[dict[tuple[bool, int], float]], dict[tuple, float]]:
    """Expectation-maximisation over counts of vote patterns: share of true spans, each labeler's chance of each vote
    given the truth, and the posterior of each pattern. Votes count as independent given the truth; a labeler starts
    out as right in four of five cases."""
    labelers = len(next(iter(patterns)))
    share = START
    chance = [{(truth, v): (0.3 if v == 0 else 0.56 if (v == 1) == truth else 0.14) for truth in (True, False) for v in (-1, 0, 1)} for _ in range(labelers)]
    posterior: dict[tuple, float] = {}
    for _ in range(ROUNDS):
        for votes in patterns:
            p, q = share, 1 - share
            for i, v in enumerate(votes):
                p *= chance[i][True, v]
                q *= chance[i][False, v]
            posterior[votes] = p / (p + q) if p + q else share
        total = sum(patterns.values())
        right = sum(n * posterior[v] for v, n in patterns.items())
        share = (right + SMOOTHING) / (total + 2 * SMOOTHING)
        for i in range(labelers):
            sums: dict[tuple[bool, int], float] = defaultdict(float)
            for votes, n in patterns.items():
                sums[True, votes[i]] += n * posterior[votes]
                sums[False, votes[i]] += n * (1 - posterior[votes])
            for truth, mass in ((True, right), (False, total - right)):
                for v in (-1, 0, 1):
                    chance[i][truth, v] = (sums[truth, v] + SMOOTHING) / (mass + 3 * SMOOTHING)
    return share, chance, posterior


def classifier(rows: list[tuple[tuple, float, int]], steps: int = 400, rate: float = 0.5, decay: float = 1e-3) -> dict[tuple, float]:
    """Logistic weights of each (feature, value) and of the bias (-1, 0), from (values, target, count)."""
    weights: dict[tuple, float] = defaultdict(float)
    total = sum(n for *_, n in rows) or 1
    for _ in range(steps):
        slope: dict[tuple, float] = defaultdict(float)
        for values, target, n in rows:
            keys = [(-1, 0), *enumerate(values)]
            z = sum(weights[k] for k in keys)
            error = (1 / (1 + math.exp(-max(-30, min(30, z)))) - target) * n / total
            for k in keys:
                slope[k] += error
        for k, g in slope.items():
            weights[k] -= rate * (g + decay * weights[k])
    return dict(weights)


def learn(found: DataFrame) -> dict[int, dict[tuple, float]]:
    """Weights per kind. Gathers the counts of (kind, votes, surroundings): at most 4 * 81 * 8 rows."""
    counts = found.select(F.explode("__pii").alias("x")).groupBy(*[F.col(f"x.{c}").alias(c) for c in ("kind", *FEATURES)]).count().collect()
    by_kind: dict[int, list] = defaultdict(list)
    for r in counts:
        by_kind[r.kind].append((tuple(r[f] for f in FEATURES), r["count"]))
    out = {}
    for kind, rows in sorted(by_kind.items()):
        patterns: dict[tuple, int] = defaultdict(int)
        for values, n in sorted(rows):
            patterns[values[:4]] += n
        _, _, posterior = reliabilities(patterns)
        out[kind] = classifier([(values, posterior[values[:4]], n) for values, n in sorted(rows)])
    return out


def probability(x: Column, weights: dict[int, dict[tuple, float]]) -> Column:
    """The span classifier's probability for a candidate."""
    score = F.lit(0.0)
    for kind, by_value in weights.items():
        total = F.lit(by_value.get((-1, 0), 0.0))
        for i, name in enumerate(FEATURES):
            pick = F.lit(0.0)
            for (f, v), w in by_value.items():
                if f == i:
                    pick = F.when(x[name] == v, F.lit(w)).otherwise(pick)
            total = total + pick
        score = F.when(x["kind"] == kind, total).otherwise(score)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def find(docs: DataFrame, text_col: str = "text", least: float = LEAST, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (None: all) with the array columns base_spans and spans of (kind, start, end), ordered by kind as in KINDS, then start.

    base_spans are the rules' spans; spans adds what the classifier finds with probability `least` or more and what
    overlaps no base span. Places are code points of the whole text, ends exclusive. A null or empty text has no
    spans; repeated rows stay; an empty table gives no rows. Columns of docs called base_spans, spans, __pii or __more are replaced.
    """
    found = candidates(docs.drop("base_spans", "spans", "__pii", "__more"), text_col, keep)
    weights = learn(found)
    bare = lambda a: F.transform(a, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    base = F.array_sort(bare(F.filter("__pii", lambda x: x["base"])))
    more = F.filter("__pii", lambda x: ~x["base"] & (probability(x, weights) >= least)) if weights else F.filter("__pii", lambda x: F.lit(False))
    found = found.select(*[F.col(c) for c in found.columns if c != "__pii"], base.alias("base_spans"), F.array_sort(bare(more)).alias("__more"))
    spans = F.when(F.size("__more") == 0, F.col("base_spans")).otherwise(F.array_sort(F.concat("base_spans", _clear(F.col("__more"), F.col("base_spans")))))
    return found.withColumn("spans", spans).drop("__more")


SPAN = "array<struct<kind:int,start:int,end:int>>"


def _clear(more: Column, base: Column) -> Column:
    """The spans of `more`, each once, that overlap none of `base`: by one look from the left at how far base spans
    reach and one from the right at where the next begins."""
    placed = lambda a, own: F.transform(a, lambda x: F.struct(x["start"].alias("start"), F.lit(own).alias("more"), x["end"].alias("end"), x["kind"].alias("kind")))
    far = F.lit(2**31 - 1)

    def kept(both: Column) -> Column:
        reach = running(F.transform(both, lambda x: F.when(x["more"], 0).otherwise(x["end"])), "int", F.greatest, F.lit(0))
        ahead = F.reverse(running(F.reverse(F.transform(both, lambda x: F.when(x["more"], far).otherwise(x["start"]))), "int", F.least, far))
        free = lambda x, i, r, n: x["more"] & (F.get(r, i) <= x["start"]) & (F.get(n, i) >= x["end"]) & ~F.coalesce(F.get(both, i - 1) == x, F.lit(False))
        return _let(reach, lambda r: _let(ahead, lambda n: F.filter(both, lambda x, i: free(x, i, r, n))))

    out = _let(F.array_sort(F.concat(placed(more, True), placed(base, False))), kept)
    return F.transform(out, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).cast(SPAN)


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each stretch covered by spans replaced by its first span's kind in brackets. The text is cut into
    slabs once, and each piece that stays is taken out of its slabs."""
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))

    def between(slabs: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / SLAB).cast("int"), F.floor((b - 1) / SLAB).cast("int")
        inner = F.substring(F.get(slabs, first), a % SLAB + 1, b - a)
        wide = F.concat(F.substring(F.get(slabs, first), a % SLAB + 1, F.lit(SLAB)), F.array_join(F.slice(slabs, first + 2, last - first - 1), ""), F.substring(F.get(slabs, last), F.lit(1), (b - 1) % SLAB + 1))
        return F.when(b <= a, "").when(first == last, inner).otherwise(wide)

    def pieces(slabs: Column, order: Column, reach: Column) -> Column:
        from_ = lambda i: F.when(i == 0, 0).otherwise(F.get(reach, i - 1))
        mark = lambda x, i: F.when(x["start"] >= from_(i), F.get(names, x["kind"])).otherwise("")
        kept = F.transform(order, lambda x, i: F.concat(between(slabs, from_(i), x["start"]), mark(x, i)))
        return F.concat(F.array_join(kept, ""), between(slabs, F.element_at(reach, -1), F.length(text)))

    by_place = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    reach = lambda order: running(F.transform(order, lambda x: x["end"]), "int", F.greatest, F.lit(0))
    slabs = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{SLAB}}}"), F.lit(0))
    new = _let(slabs, lambda s: _let(by_place, lambda o: _let(reach(o), lambda r: pieces(s, o, r))))
    return F.when(F.size(spans) == 0, text).otherwise(new)


def cleaned(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with personal data replaced in the text, and the length column set anew where the text changed. All other
    columns, whatever their names, come back as they were."""
    others = [c for c in docs.columns if c not in (text_col, length_col)]
    rows = docs.select(F.col(text_col).alias("text"), *([F.col(length_col).alias("n")] if length_col else []), F.struct(*others).alias("row") if others else F.lit(None).alias("row"))
    found = find(rows, "text")
    found = found.withColumn("new", redact(F.col("text"), F.col("spans")))
    back = {c: F.col("row")[c] for c in others} | {text_col: F.col("new")}
    if length_col:
        back[length_col] = F.when(F.size("spans") > 0, F.length("new").cast("long")).otherwise(F.col("n"))
    return found.select(*[back[c].alias(c) for c in docs.columns])
