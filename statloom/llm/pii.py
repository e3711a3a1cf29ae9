"""Personal data: candidates, boosted trees and calibrated thresholds.

Base rules find emails, network addresses, card numbers and phone numbers by pattern and by
check (octets, digits, Luhn); their spans always stand. Wide generators propose further,
overlapping spans of the same kinds. Each candidate has format features (digits, signs, checks)
and context features (the characters beside it, a telling word before it). Boosted regression trees score
it, and it is added where its score reaches its kind's threshold and it overlaps no base span or
added span that begins before it.

No table marks personal data, so the trees learn from weak labels that are not the base rule. Base spans are
rewritten in their own surroundings into forms the base rules miss (phone numbers without a plus sign or behind
a telling word, addresses with ``(at)`` and ``(dot)``, other separators): positive. Number runs in other
surroundings (dates, sums, versions, failed checks), mentions, and candidates that touch a letter and no base
span are negative. Other candidates that are no base span are unknown and left out. At most ``SAMPLE`` examples
are made, from the spans with the lowest hash; in a quarter of those fitted the plus and at signs are masked.
Another quarter, split by the span rewritten, is left out of the fit and sets each kind's threshold: the lowest score
from which on ``PRECISION`` of the examples that are no base spans are positive (none: nothing is added). The
fitted trees are one column expression: texts are read, matched and scored by DataFrame functions only.

Places count code points, ends are exclusive. Null and empty texts have no spans. Repeated rows
are treated alike. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.tables import free_names

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 20_000
PRECISION = 0.99
TREES, DEPTH, RATE, LEAST = 12, 3, 0.4, 20

# The look-behind, or the end of the match before, keeps long runs from being tried from each of their characters.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?<![\w.%+-])[\w.%+-]{1,64}+ ?(?:@|\(at\)|\[at\]) ?[\w-]{1,63}+(?:(?: ?(?:\(dot\)|\[dot\]) ?|\.| \. )[\w-]{1,63}+){1,5}",
    "number": r"(?<![0-9])[+(]?[0-9](?:[ ().-]{0,2}[0-9]){6,18}+(?![0-9])",
}
TELLING = r"(?i)(mail|contact|tel|phone|call|fax|mobile|card|visa|account|ip|host|addr)\W{0,3}$"

FEATURES = ("kind", "digits", "length", "signs", "dots", "plus", "at", "octets", "luhn", "letter_before", "digit_before", "letter_after", "telling", "line_start", "groups", "first_group", "last_group", "marks", "blank_dots", "word_end")


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes."""
    values = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 0, c.try_cast("int")).otherwise(2 * c.try_cast("int") - F.when(c.try_cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def passes(kind: str, s: Column) -> Column:
    n = F.length(digits(s))
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda p: F.coalesce(p.try_cast("decimal(38,0)"), F.lit(999)) <= 255)
    if kind == "card":
        return n.between(12, 19) & luhn(digits(s))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a generator, so that they are worked out once."""
    return df.select(*df.columns, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def located(pieces: Column, found: Column) -> Column:
    """(start, value) of each match, from the pieces between the matches."""
    empty = F.array().cast("array<struct<start:int,value:string>>")
    begin = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["piece"])
        value = F.coalesce(pair["value"], F.lit(""))
        return F.struct((start + F.length(value)).alias("at"), F.concat(state["out"], F.array(F.struct(start.alias("start"), value.alias("value")))).alias("out"))

    pairs = F.arrays_zip(pieces.alias("piece"), found.alias("value"))
    pairs = F.filter(pairs, lambda p: p["value"].isNotNull())
    return F.aggregate(pairs, begin, step, lambda state: state["out"])


def matched(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """Add, for each pattern, the array of (start, value) of its matches in order."""
    names = list(patterns)
    found = held(df, **{f"_m_{n}": F.regexp_extract_all(text, F.lit(patterns[n]), 0) for n in names})
    pieces = held(found, **{f"_p_{n}": F.when(F.size(f"_m_{n}") > 0, F.split(text, patterns[n], -1)).otherwise(F.array().cast("array<string>")) for n in names})
    placed = held(pieces, **{n: located(F.col(f"_p_{n}"), F.col(f"_m_{n}")) for n in names})
    return placed.drop(*[f"_{k}_{n}" for n in names for k in "mp"])


def spans(docs: DataFrame, key: list[str], text: str) -> DataFrame:
    """key, text, base (an array of start, stop, kind place, value) and wide (the same of candidates)."""
    found = matched(docs.select(*key, F.coalesce(F.col(text), F.lit("")).alias("_t")), "_t", {**{f"_b_{k}": p for k, p in BASE.items()}, **{f"_w_{k}": p for k, p in WIDE.items()}})

    def as_spans(name: str, kind: Column, good) -> Column:
        kept = F.filter(name, lambda m: good(m["value"]))
        return F.transform(kept, lambda m: F.struct(m["start"].alias("start"), (m["start"] + F.length(m["value"])).alias("stop"), kind(m["value"]).alias("kind"), m["value"].alias("value")))

    def guess(v: Column) -> Column:
        return F.when(v.rlike(r"^[0-9]{1,3}(?: ?\. ?[0-9]{1,3}){3}$"), 1).when(~v.startswith("+") & (F.length(digits(v)) >= 12) & luhn(digits(v)), 2).otherwise(3)

    base = F.sort_array(F.concat(*[as_spans(f"_b_{k}", lambda v, i=i: F.lit(i), lambda v, k=k: passes(k, v)) for i, k in enumerate(KINDS)]))
    base = F.sort_array(F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"))))
    wide = F.concat(as_spans("_w_email", lambda v: F.lit(0), lambda v: F.lit(True)), as_spans("_w_number", guess, lambda v: F.lit(True)))
    wide = F.transform(wide, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"), s["value"].alias("value")))
    return held(found.select(*key, "_t", *[f"_b_{k}" for k in KINDS], *[f"_w_{k}" for k in WIDE]), _base=base, _wide=wide).select(*key, "_t", "_base", "_wide")


def features(text: Column, span: Column) -> Column:
    """The features of a candidate, as an array of doubles in the order of ``FEATURES``."""
    v, start = span["value"], span["start"]
    before, after = F.substr(text, start, F.lit(1)), F.substr(text, span["stop"] + 1, F.lit(1))
    before = F.when(start > 0, before).otherwise("\n")
    near = F.substr(text, F.greatest(start - 15, F.lit(1)), F.least(start, F.lit(16)))
    n = digits(v)
    values = [
        span["kind"], F.length(n), F.length(v), F.length(F.regexp_replace(v, r"[^ ()-]", "")), F.length(F.regexp_replace(v, r"[^.]", "")),
        v.startswith("+"), v.contains("@"), (span["kind"] == 1) & passes("ip", v), luhn(n),
        before.rlike(r"\p{L}"), before.rlike("[0-9]"), after.rlike(r"\p{L}"), near.rlike(TELLING), before == "\n",
        F.regexp_count(v, F.lit("[0-9]+")), F.length(F.regexp_extract(v, "[0-9]+", 0)), F.length(F.regexp_extract(v, "([0-9]+)[^0-9]*$", 1)),
        F.regexp_count(v, F.lit(r"[(\[](at|dot)[)\]]")), F.regexp_count(v, F.lit(r" \.|\. ")), v.rlike("(?<![A-Za-z])[a-z]{2,}$"),
    ]
    return F.array(*[x.cast("double") for x in values])


@dataclass(frozen=True)
class Trees:
    """Nested (feature, cut, left, right) or leaf values, and the least log odds of each kind."""

    trees: tuple
    thresholds: tuple[float, ...]

    def log_odds(self, x: Column) -> Column:
        def walk(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            return F.when(x[node[0]] <= node[1], walk(node[2])).otherwise(walk(node[3]))

        return sum((walk(t) for t in self.trees), F.lit(0.0))


def grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int):
    """A regression tree by second-order gain."""
    value = float(RATE * gradient.sum() / (hessian.sum() + 1.0))
    if depth == 0 or len(x) < 2 * LEAST:
        return value
    best, gain = None, 1e-6
    whole = gradient.sum() ** 2 / (hessian.sum() + 1.0)
    for f in range(x.shape[1]):
        for cut in np.unique(x[:, f])[:-1][:64]:
            left = x[:, f] <= cut
            if min(left.sum(), (~left).sum()) < LEAST:
                continue
            parts = sum(gradient[m].sum() ** 2 / (hessian[m].sum() + 1.0) for m in (left, ~left))
            if parts - whole > gain:
                best, gain = (f, float(cut), left), parts - whole
    if best is None:
        return value
    f, cut, left = best
    return (f, cut, grow(x[left], gradient[left], hessian[left], depth - 1), grow(x[~left], gradient[~left], hessian[~left], depth - 1))


def apply(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    return np.where(x[:, tree[0]] <= tree[1], apply(tree[2], x), apply(tree[3], x))


def boost(x: np.ndarray, y: np.ndarray, out: np.ndarray | None = None, counts: np.ndarray | None = None) -> Trees:
    """Logistic boosting; the thresholds come from the rows left ``out`` of the fit that count."""
    if not len(x):
        return Trees((), (np.inf,) * len(KINDS))
    out = np.arange(len(x)) % 4 == 3 if out is None else out
    counts = np.ones(len(x), bool) if counts is None else counts
    power, trees = np.zeros(len(x)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-power))
        trees.append(grow(x[~out], (y - p)[~out], (p * (1 - p))[~out], DEPTH))
        power += apply(trees[-1], x)
    cuts = []
    for kind in range(len(KINDS)):
        mine = out & counts & (x[:, 0] == kind)
        order = np.argsort(-power[mine], kind="stable")
        s, good = power[mine][order], np.cumsum(y[mine][order])
        last = np.append(s[1:] != s[:-1], True) if len(s) else np.zeros(0, bool)
        right = np.flatnonzero(last & (good >= PRECISION * np.arange(1, len(s) + 1)) & (s > 0))
        cuts.append(float(s[right[-1]]) if len(right) else np.inf)
    return Trees(tuple(trees), tuple(cuts))


def sources(found: DataFrame) -> DataFrame:
    """Base spans, and candidates that touch a letter and no base span, each once with what stands around it."""
    apart = lambda s: ~F.exists("_base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))
    lettered = lambda s: (F.substr("_t", s["start"], F.lit(1)).rlike(r"\p{L}") & (s["start"] > 0)) | F.substr("_t", s["stop"] + 1, F.lit(1)).rlike(r"\p{L}")
    plain = lambda rows, base: F.transform(rows, lambda s: F.struct(F.lit(base).alias("base"), s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    each = found.select("_t", F.explode(F.concat(plain("_base", True), plain(F.filter("_wide", lambda s: lettered(s) & apart(s)), False))).alias("s"))
    start, stop = F.col("s.start"), F.col("s.stop")
    texts = {
        "before": F.substr("_t", F.greatest(start - 39, F.lit(1)), F.least(start, F.lit(40))),
        "value": F.substr("_t", start + 1, stop - start),
        "after": F.substr("_t", stop + 1, F.lit(12)),
    }
    rows = each.filter(stop - start <= 100).select("s.base", "s.kind", *[c.alias(n) for n, c in texts.items()])
    return rows.withColumn("h", F.xxhash64(*rows.columns)).dropDuplicates()


def rewritten() -> Column:
    """(how, kind, y, before, value) of the examples made of a source; ``as it is`` is no example of what is added."""
    v, h, before = F.col("value"), F.col("h"), F.col("before")
    kind = F.col("kind")
    neutral = F.regexp_replace(before, TELLING, "... ")
    z = F.rpad(F.regexp_replace(h.cast("string"), "-", ""), 19, "5")
    part = lambda a, n: F.substr(z, F.lit(a), F.lit(n))

    def example(how: str, y: int, value: Column, ahead: Column = before, k=kind) -> Column:
        return F.struct(F.lit(how).alias("how"), k.cast("int").alias("kind"), F.lit(y).alias("y"), ahead.alias("before"), value.alias("value"))

    local = F.regexp_replace(v, r"^\+[0-9]{1,3}[ .-]*(?=[0-9(])", "")
    spaced = lambda sign: F.regexp_replace(F.regexp_replace(local, "[()]", ""), "[ .-]+", sign)
    user, host = F.regexp_extract(v, "^([^@]*)@", 1), F.regexp_extract(v, "@(.*)$", 1)
    hidden = lambda at, dot: F.concat(user, F.lit(at), F.regexp_replace(host, r"\.", dot))
    word = F.regexp_replace(user, "[^A-Za-z]", "")
    fours = lambda d, sign: F.regexp_replace(d, "([0-9]{4})(?=[0-9])", f"$1{sign}")
    d = digits(v)
    spoilt = F.concat(F.substr(d, F.lit(1), F.length(d) - 1), ((F.substr(d, F.length(d), F.lit(1)).try_cast("int") + 1) % 10).cast("string"))
    wrong = F.regexp_replace(v, "^[0-9]+", "734")
    own = {
        0: [example("(at)(dot)", 1, hidden("(at)", "(dot)")), example("(at) (dot)", 1, hidden(" (at) ", " (dot) ")), example("[at][dot]", 1, hidden("[at]", "[dot]")),
            example("(at) and dots", 1, hidden(" (at) ", ".")), example("blanks at the sign", 1, hidden(" @ ", ".")),
            example("mention", 0, F.concat(word, F.lit(" @ "), word, F.lit(" . Then"))), example("price", 0, F.concat(word, F.lit(" (at) "), part(1, 2), F.lit("."), part(3, 2)))],
        1: [example("dot blank", 1, F.regexp_replace(v, r"\.", ". ")), example("blank dot", 1, F.regexp_replace(v, r"\.", " .")),
            example("octet too large", 0, wrong, neutral), example("octet too large, blanks", 0, F.regexp_replace(wrong, r"\.", ". "), neutral)],
        2: [example("dots", 1, fours(d, ".")), example("two blanks", 1, fours(d, "  ")), example("dots and blanks", 1, fours(d, ". ")),
            example("failed check", 0, fours(spoilt, "."), neutral), example("failed check, blanks", 0, fours(spoilt, " "), neutral)],
        3: [example("no plus", 1, F.substr(v, F.lit(2), F.length(v))), example("double zero", 1, F.concat(F.lit("00"), F.substr(v, F.lit(2), F.length(v)))), example("local", 1, local),
            example("dots", 1, spaced(".")), example("dashes", 1, spaced("-")), example("blanks", 1, spaced(" ")),
            example("behind a word", 1, digits(local), F.concat(before, F.lit("tel ")))],
    }
    runs = {
        "plain run": F.substr(z, F.lit(1), (7 + F.pmod(h, F.lit(13))).cast("int")),
        "date": F.concat(F.lit("20"), part(1, 2), F.lit("-0"), part(3, 1), F.lit("-1"), part(4, 1)),
        "date with dots": F.concat(F.lit("1"), part(1, 1), F.lit(".0"), part(2, 1), F.lit(".20"), part(3, 2)),
        "thousands": F.concat(part(1, 2), F.lit("."), part(3, 3), F.lit("."), part(6, 3)),
        "thousands, blanks": F.concat(part(1, 1), F.lit(" "), part(2, 3), F.lit(" "), part(5, 3), F.lit(" "), part(8, 3)),
        "decimal": F.concat(part(1, 4), F.lit("."), part(5, 5)),
        "years": F.concat(F.lit("19"), part(1, 2), F.lit(" 19"), part(3, 2), F.lit(" 20"), part(5, 2)),
        "version": F.concat(part(1, 1), F.lit("."), part(2, 2), F.lit("."), part(4, 4)),
    }
    as_is = example("as it is", 1, v)
    negative = [example(n, 0, value, neutral) for n, value in runs.items()]
    lists = F.when(kind == 0, F.array(as_is, *own[0], *negative))
    for k in (1, 2, 3):
        lists = lists.when(kind == k, F.array(as_is, *own[k], *negative))
    # A number written without separators has no other way of separating it.
    made = F.filter(lists, lambda e: (kind != 3) | (e["y"] == 0) | e["how"].isin("as it is", "behind a word") | (e["value"] != digits(e["value"])))
    return F.when(F.col("base"), made).otherwise(F.array(example("beside a letter", 0, v)))


def examples(docs: DataFrame, text: str = "text", most: int = SAMPLE) -> DataFrame:
    """how, kind, y, held (left out of the fit) and the features x of at most ``most`` weakly labelled examples.

    The features are null where the wide generators do not propose the span under its kind.
    """
    chosen = sources(spans(docs, [], text)).orderBy("h").limit(most // 16)
    each = chosen.select("h", "after", F.inline(rewritten()))
    marked = each.select("h", "how", "kind", "y", F.length("before").alias("start"), (F.length("before") + F.length("value")).alias("stop"), F.concat("before", "value", "after").alias("_x"))
    found = spans(marked, ["h", "how", "kind", "y", "start", "stop"], "_x")
    here = F.filter("_wide", lambda s: (s["start"] == F.col("start")) & (s["stop"] == F.col("stop")) & ((F.col("y") == 0) | (s["kind"] == F.col("kind"))))
    known = F.exists("_base", lambda b: (b["start"] < F.col("stop")) & (F.col("start") < b["stop"]))
    hit = held(found, _hit=F.get(here, F.lit(0))).filter(~known | (F.col("how") == "as it is"))
    x = F.when(F.col("_hit").isNotNull(), features(F.col("_t"), F.col("_hit")))
    return hit.select("h", "how", "kind", "y", (F.pmod("h", F.lit(4)) == 3).alias("held"), x.alias("x"))


def trained(rows: list) -> Trees:
    """Fit and calibrate on collected examples."""
    rows = [r for r in rows if r["x"] is not None]
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), len(FEATURES))
    out = np.array([r["held"] for r in rows], bool)
    masked = np.flatnonzero(~out)[::4]
    x[np.ix_(masked, [FEATURES.index("plus"), FEATURES.index("at")])] = 0
    return boost(x, np.array([r["y"] for r in rows], float), out, np.array([r["how"] != "as it is" for r in rows], bool))


def collected(docs: DataFrame, text: str = "text", most: int = SAMPLE) -> list:
    return sorted(examples(docs, text, most).collect(), key=lambda r: (r["h"], r["how"]))


def fit(docs: DataFrame, text: str = "text", most: int = SAMPLE) -> Trees:
    return trained(collected(docs, text, most))


def held_out(rows: list, model: Trees) -> dict[str, tuple[int, int, int]]:
    """Per kind, of the examples left out of the fit that are no base spans: positives, positives added, negatives added."""
    out = {k: [0, 0, 0] for k in KINDS}
    for r in rows:
        if not r["held"] or r["how"] == "as it is":
            continue
        x = None if r["x"] is None else np.array([r["x"]], float)
        kind = r["kind"] if x is None else int(x[0, 0])
        added = x is not None and sum(apply(t, x)[0] for t in model.trees) >= model.thresholds[kind]
        out[KINDS[kind]][0] += r["y"]
        out[KINDS[kind]][1 if r["y"] else 2] += bool(added)
    return {k: tuple(v) for k, v in out.items()}


def redactions(docs: DataFrame, model: Trees, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, base and spans: arrays of (start, kind place, stop) in order, the second with the added spans."""
    found = spans(docs, [key], text)
    bound = F.array(*[F.lit(float(t)) for t in model.thresholds])
    scored = F.transform("_wide", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"), features(F.col("_t"), s).alias("x")))
    scored = held(found, _scored=F.when(F.size("_wide") > 0, scored))
    apart = lambda s: ~F.exists("_base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))
    extra = F.filter("_scored", lambda s: (model.log_odds(s["x"]) >= F.element_at(bound, s["kind"] + 1)) & apart(s))
    plain = F.sort_array(F.transform(extra, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"))))
    begin = F.struct(F.lit(0).alias("stop"), F.array().cast("array<struct<start:int,kind:int,stop:int>>").alias("out"))
    first = F.aggregate(plain, begin, lambda a, s: F.when(s["start"] >= a["stop"], F.struct(s["stop"].alias("stop"), F.concat(a["out"], F.array(s)).alias("out"))).otherwise(a), lambda a: a["out"])
    every = F.sort_array(F.concat("_base", F.coalesce(first, F.array().cast("array<struct<start:int,kind:int,stop:int>>"))))
    return held(scored, _all=every).select(F.col(key), F.col("_base").alias("base"), F.col("_all").alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["stop"].cast("string"))), ",")


def redact(docs: DataFrame, model: Trees, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in brackets, in a column ``redacted``."""
    (name,) = free_names(docs, "redacted")
    found = redactions(docs.select(F.struct(key, text).alias("_d"), text), model, "_d", text)
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    body = F.coalesce(F.col(f"_d.{text}"), F.lit(""))

    def step(a: Column, s: Column) -> Column:
        here = s["start"] >= a["at"]
        gap = F.substr(body, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))
        out = F.concat(a["out"], F.when(here, F.concat(gap, F.element_at(names, s["kind"] + 1))).otherwise(""))
        return F.struct(F.greatest(a["at"], s["stop"]).alias("at"), out.alias("out"))

    done = F.aggregate("spans", begin, step, lambda a: F.concat(a["out"], F.substr(body, a["at"] + 1, F.length(body))))
    return found.select("_d.*", done.alias(name))
