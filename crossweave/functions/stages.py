"""Row windows of many operators, computed together.

A sliding frame adds every row of the frame up again for each row. Here a statistic of ``n`` rows is put together from the same
statistic of shorter stretches that end a few rows earlier: 1 row, 5, 10, 20, 60, … All stretches of a length travel as one array, so a row is
moved a few times however many statistics are asked for, and the cost of a frame grows with the logarithm of its length.

An operator is a generator over stages. It yields a list of what it asks of the rows before (``mean``, ``std``, ``lag``, ``running``, …) and
receives as many columns; it may ask again with these, and returns its output columns by name. ``together`` runs several such
operators at once: what they ask in one stage shares its windows.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import col
from .rolling import Series

#: how many stretches make the next longer one; the last number repeats
JOINED = (5, 2, 2, 3, 4)
#: most stretches of one length that make a frame
PIECES = 5

Stages = Generator[list["Ask"], list[Column], Mapping[str, Column]]


@dataclass(frozen=True)
class Ask:
    """Something a row wants to know of its series: ``solve`` answers all of one kind at once."""

    solve: Callable
    kind: str
    xs: tuple[Column, ...]
    n: int = 1
    m: int = 1
    back: int = 0
    more: tuple = ()


def _ask(kind: str, xs, n: int, m: int | None, back: int = 0) -> Ask:
    return Ask(row_windows, kind, tuple(col(x) for x in xs), n, n if m is None else m, back)


def lag(x, n: int = 1) -> Ask:
    return _ask("lag", [x], n, None)


def running(aggregate: Column) -> Ask:
    """An aggregate over all rows up to this one."""
    return _ask("running", [aggregate], 1, None)


def streaks(hits: Sequence[Column]) -> Stages:
    """Lengths of the current runs of true rows, 0 on a false row (``yield from`` it); a hit is never null."""
    (n,) = yield [running(F.count(F.lit(1)))]
    missed = yield [running(F.max(F.when(~h, n))) for h in hits]
    return [n - F.coalesce(x, F.lit(0.0)) for x in missed]


def mean(x, n: int, m: int | None = None, back: int = 0, in_order: bool = False) -> Ask:
    """Mean of the last ``n`` rows, ``back`` rows ago; null unless ``m`` of them hold a value. The others likewise.

    ``in_order`` adds row after row, oldest first: for a mean that may come out as nothing and is divided by.
    """
    return replace(_ask("mean", [x], n, m, back), more=("in order",) if in_order else ())


def total(x, n: int, m: int | None = None) -> Ask:
    return _ask("total", [x], n, m)


def highest(x, n: int, m: int | None = None) -> Ask:
    return _ask("highest", [x], n, m)


def lowest(x, n: int, m: int | None = None) -> Ask:
    return _ask("lowest", [x], n, m)


def product(x, n: int, m: int | None = None) -> Ask:
    return _ask("product", [x], n, m)


def std(x, n: int, m: int | None = None) -> Ask:
    # one value has no sample deviation
    return _ask("std", [x], n, max(2, n if m is None else m))


def skew(x, n: int, m: int | None = None) -> Ask:
    """Bias-corrected skewness."""
    return _ask("skew", [x], n, m)


def kurtosis(x, n: int, m: int | None = None) -> Ask:
    """Bias-corrected excess kurtosis."""
    return _ask("kurtosis", [x], n, m)


def corr(x, y, n: int, m: int | None = None) -> Ask:
    """Pairwise-complete correlation; null if one side is constant."""
    both = col(x).isNotNull() & col(y).isNotNull()
    return _ask("corr", [F.when(both, col(x)), F.when(both, col(y))], n, m)


def mean_deviation(x, n: int) -> Ask:
    """Mean distance of the values from their mean; null if all are equal."""
    return _ask("mean_deviation", [x], n, 1)


#: what has to be known of each stretch for an answer
PARTS = {
    "mean": ("n", "s"), "total": ("n", "s"), "highest": ("n", "hi"), "lowest": ("n", "lo"), "product": ("n", "p"), "std": ("n", "a", "m2"),
    "skew": ("n", "a", "m2", "m3", "hi", "lo"), "kurtosis": ("n", "a", "m2", "m3", "m4", "hi", "lo"), "corr": ("n", "a", "m2"), "mean_deviation": ("n", "s", "hi", "lo"),
}


def spans_below(n: int) -> list[int]:
    out = [1]
    while out[-1] < n:
        out.append(out[-1] * JOINED[min(len(out) - 1, len(JOINED) - 1)])
    return out[:-1] or [1]


def pieces(n: int, back: int = 0, overlap: bool = False, longest: int | None = None) -> list[tuple[int, int]]:
    """(length, rows back) of the stretches that make the ``n`` rows; where they may ``overlap`` all are of one length."""
    spans = [s for s in spans_below(n) if longest is None or s <= longest]
    size = max(s for s in spans if s == 1 or 2 * s <= n)
    if -(-n // size) > PIECES:
        size = min([s for s in spans if s > size], default=size)
    if overlap:
        return [(size, back + min(i * size, n - size)) for i in range(-(-n // size))]
    out, at = [], 0
    for s in reversed([s for s in spans if s <= size]):
        while n - at >= s:
            out.append((s, back + at))
            at += s
    return out


#: what a stretch without values holds; then no entry is ever null
EMPTY = {"n": "0D", "s": "0D", "p": "1D", "hi": "-double('Infinity')", "lo": "double('NaN')", "a": "0D", "m2": "0D", "m3": "0D", "m4": "0D", "c": "0D", "v": "0D", "u": "0D"}
#: parts that one row has; it has no moments of its own
SINGLE = ("n", "s", "p", "hi", "lo", "a", "v", "u")


def _sum(terms: Sequence[str]) -> str:
    return f"({' + '.join(terms)})" if terms else "0D"


class _Merge:
    """SQL text of what stretches laid end to end hold. Moments are taken about the mean of the first stretch that has values and shifted
    to the common mean: equal values leave exactly nothing. Anchors and power sums are columns of their own (``helpers``)."""

    def __init__(self, parts: Sequence[Callable], name: str):
        self.parts, self.name = parts, name
        self.anchors: dict[str, str] = {}
        self.powers: dict[str, str] = {}

    def every(self, kind: str, i: int) -> list[str]:
        return [p((kind, i)) for p in self.parts]

    def count(self, i: int) -> str:
        return _sum(self.every("n", i))

    def anchor(self, i: int) -> str:
        whens = " ".join(f"WHEN {n} > 0D THEN {a}" for n, a in zip(self.every("n", i), self.every("a", i)))
        place = list(self.anchors).index(i) if i in self.anchors else len(self.anchors)
        self.anchors[i] = f"CASE {whens} ELSE 0D END"
        return f"{self.name}_a[{place}]"

    def away(self, p: Callable, i: int) -> str:
        return f"({p(('a', i))} - {self.anchor(i)})"

    def power(self, k: int, i: int) -> str:
        terms = []
        for p in self.parts:
            e, m2 = self.away(p, i), p(("m2", i))
            terms.append(" * ".join([p(("n", i)), *[e] * k]))
            if m2 and k > 1:
                terms += [p((f"m{k}", i)), *([f"3D * {e} * {m2}"] if k == 3 else [f"4D * {e} * {p(('m3', i))}", f"6D * {e} * {e} * {m2}"] if k == 4 else [])]
        return self.stored((k, i), _sum(terms))

    def stored(self, key: tuple, text: str) -> str:
        self.powers[key] = text
        return f"{self.name}_p[{list(self.powers).index(key)}]"

    def text(self, key: tuple) -> str:
        kind, i = key[0], key[1]
        if len(self.parts) == 1:
            return self.parts[0](key) or EMPTY[kind]
        if kind in ("n", "s"):
            return _sum(self.every(kind, i)[::-1])
        if kind == "p":
            return f"({' * '.join(self.every(kind, i))})"
        if kind in ("hi", "lo"):
            return f"{'greatest' if kind == 'hi' else 'least'}({', '.join(self.every(kind, i))})"
        n = f"greatest({self.count(i)}, 1D)"
        if kind == "c":
            j = key[2]
            terms = [t for p in self.parts for t in (p(key), f"{p(('n', i))} * {self.away(p, i)} * {self.away(p, j)}") if t]
            return f"({self.stored(key, _sum(terms))} - {self.power(1, i)} * {self.power(1, j)} / {n})"
        s1 = self.power(1, i)
        d = f"({s1} / {n})"
        if kind == "a":
            return f"({self.anchor(i)} + {d})"
        s2 = self.power(2, i)
        if kind == "m2":
            return f"({s2} - {s1} * {d})"
        s3 = self.power(3, i)
        if kind == "m3":
            return f"({s3} - 3D * {d} * {s2} + 2D * {d} * {d} * {s1})"
        return f"({self.power(4, i)} - 4D * {d} * {s3} + 6D * {d} * {d} * {s2} - 3D * {d} * {d} * {d} * {s1})"


def _answer(ask: Ask, get: Callable) -> str:
    n = get("n")
    known = f"greatest({n}, 1D)"
    if ask.kind == "mean":
        value = f"{get('s')} / {known}"
    elif ask.kind in ("total", "highest", "lowest", "product"):
        value = get(PARTS[ask.kind][1])
    elif ask.kind == "std":
        value = f"sqrt({get('m2')} / greatest({n} - 1D, 1D))"
    elif ask.kind == "skew":
        shape = f"sqrt({n}) * {get('m3')} / nullif(sqrt({get('m2')} * {get('m2')} * {get('m2')}), 0D)"
        value = f"if({n} >= 3D AND {get('hi')} > {get('lo')}, {shape} * sqrt({n} * ({n} - 1D)) / greatest({n} - 2D, 1D), NULL)"
    elif ask.kind == "kurtosis":
        shape = f"({n} * {get('m4')} / nullif({get('m2')} * {get('m2')}, 0D) - 3D)"
        value = f"if({n} >= 4D AND {get('hi')} > {get('lo')}, (({n} + 1D) * {shape} + 6D) * ({n} - 1D) / greatest(({n} - 2D) * ({n} - 3D), 1D), NULL)"
    elif ask.kind == "corr":
        value = f"{get('c')} / {known} / nullif(sqrt({get('m2')} / {known}) * sqrt({get('m2', 1)} / {known}), 0D)"
    else:
        far = _sum([f"if({u} > 0D, abs({v} - {get('s')} / {known}), 0D)" for u, v in get("v")])
        value = f"if({get('hi')} > {get('lo')}, {far} / {known}, NULL)"
    return f"if({n} >= {float(max(ask.m, 1))}D, {value}, NULL)"


def row_windows(df: DataFrame, asks: Sequence[Ask], series: Series, name: str, rows: int | None = None) -> tuple[DataFrame, list[Column]]:
    """``df`` with helper columns, and the answers over them."""
    w, so_far = series.spec, series.so_far
    own, places, answers, values = {}, {}, {}, {}
    for a in asks:
        if a.kind in ("lag", "running"):
            c = places.setdefault((a.kind, a.n, str(a.xs[0])), f"{name}_o{len(places)}")
            own[c] = F.lag(a.xs[0], a.n).over(w) if a.kind == "lag" else a.xs[0].over(so_far)
            answers[id(a)] = F.col(c)
    df = df.withColumns(own)
    rolled = [a for a in asks if id(a) not in answers]
    for a in rolled:
        for x in a.xs:
            values.setdefault(str(x), x)
    index = {text: i for i, text in enumerate(values)}

    # what has to be known of stretches of each length, and which asks are answered once it is
    made: dict[int, dict[tuple, int]] = {1: {}}
    covers, asked, due = {}, {}, {}
    for a in rolled:
        at = [index[str(x)] for x in a.xs]
        wanted = [(k, i) for i in at for k in PARTS[a.kind]] + ([("c", *at)] if a.kind == "corr" else [])
        whole = pieces(a.n, a.back, longest=JOINED[0] if a.kind == "mean_deviation" else 1 if a.more else None)
        # values may be met twice in a bound, not in their number
        bound = pieces(a.n, a.back, True) if a.kind in ("highest", "lowest") else whole
        covers[id(a)] = (whole, bound)
        asked[id(a)] = wanted
        longest = max(s for s, _ in [*whole, *bound])
        due.setdefault(longest, []).append(a)
        for s in [s for s in spans_below(longest + 1) if s <= longest]:
            each = [(k, at[0], j) for j in range(s) for k in "vu"] if a.kind == "mean_deviation" else []
            for k in [k for k in wanted if s > 1 or k[0] in SINGLE] + each:
                made.setdefault(s, {}).setdefault(k, len(made[s]))

    column = lambda span, back: f"{name}_{span}" + (f"_{back}" if back else "")
    sent: dict[tuple[int, int], dict[tuple, int]] = {}  # what of a stretch that ended earlier is asked for

    def stretch(span: int, back: int) -> Callable:
        def part(key: tuple) -> str | None:
            if key not in made[span]:
                return None
            place = sent.setdefault((span, back), {}).setdefault(key, len(sent[span, back])) if back else made[span][key]
            return f"{column(span, back)}[{place}]"

        return part

    def answer(a: Ask, merge: Callable) -> str:
        whole, bound = covers[id(a)]
        first = index[str(a.xs[0])]

        def get(kind: str, j: int = 0):
            if kind == "v":
                return [(stretch(s, b)(("u", first, i)), stretch(s, b)(("v", first, i))) for s, b in whole for i in range(s)]
            key = ("c", *[index[str(x)] for x in a.xs]) if kind == "c" else (kind, index[str(a.xs[j])])
            return merge(bound if kind in ("hi", "lo") else whole).text(key)

        return _answer(a, get)

    if values:
        given = list(values.values())
        df = df.withColumn(f"{name}_x", F.array(*[x.cast("double") for x in given]))
        raw = lambda k: f"{name}_x[{k[1]}]"
        single = [f"if({raw(k)} IS NULL, 0D, 1D)" if k[0] in "nu" else f"coalesce({raw(k)}, {EMPTY[k[0]]})" for k in made[1]]
        df = df.selectExpr(*[f"`{c}`" for c in df.columns if c != f"{name}_x"], f"array({', '.join(single)}) AS {column(1, 0)}")
    spans = sorted(made) if values else []
    for at, span in enumerate(spans):
        kept = [f"`{c}`" for c in df.columns]
        longer = spans[at + 1] if at + 1 < len(spans) else None
        merges: dict[tuple, _Merge] = {}
        sent.clear()

        def merge(cover) -> _Merge:
            return merges.setdefault(tuple(cover), _Merge([stretch(*p) for p in cover], f"{name}_{span}_{len(merges)}"))

        new, left = {}, {}
        if span in due:
            new[f"{name}_r{span}"] = [answer(a, merge) for a in due[span]]
            answers |= {id(a): F.get(f"{name}_r{span}", F.lit(i)) for i, a in enumerate(due[span])}
        if longer:
            join = merge([(span, b) for b in range(0, longer, span)])
            new[column(longer, 0)] = [join.parts[k[2] // span]((k[0], k[1], k[2] % span)) if k[0] in "vu" else join.text(k) for k in made[longer]]
        lags = {}
        for (s, back), keys in sorted(sent.items()):
            some, empty = (f"array({', '.join(x)})" for x in ([f"{column(s, 0)}[{made[s][k]}]" for k in keys], [EMPTY[k[0]] for k in keys]))
            lags[column(s, back)] = F.expr(f"lag({some}, {back}, {empty})").over(w)
        df = df.withColumns(lags)
        # of shorter stretches only what a longer round still asks for stays
        later = [a for t, some in due.items() if t > span for a in some]
        for s in [s for s in spans if s <= span]:
            keys = {}
            for a in later:
                whole, bound = covers[id(a)]
                for k in asked[id(a)]:
                    if k in made[s] and s in {t for t, _ in (bound if k[0] in ("hi", "lo") else whole)}:
                        keys.setdefault(k, len(keys))
            kept = [c for c in kept if c != f"`{column(s, 0)}`"]
            if keys:
                new[column(s, 0)] = [f"{column(s, 0)}[{made[s][k]}]" for k in keys]
            left[s] = keys
        for helpers, mark in (("anchors", "_a"), ("powers", "_p")):
            arrays = [f"array({', '.join(h.values())}) AS {x.name}{mark}" for x in merges.values() if (h := getattr(x, helpers))]
            if arrays:
                df = df.selectExpr("*", *arrays)
        df = df.selectExpr(*kept, *[f"array({', '.join(x)}) AS {c}" for c, x in new.items()])
        made |= left
    return df, [answers[id(a)].cast("double") for a in asks]


def together(df: DataFrame, runs: Sequence[Stages], series: Series | None = None, rows: int | None = None) -> DataFrame:
    """``df`` with the outputs of all operators. ``rows`` bounds the rows of one series, where the caller knows."""
    series, columns, outputs, open_ = series or Series(), df.columns, {}, []

    def advance(run: Stages, answers: list[Column] | None) -> None:
        try:
            open_.append((run, run.send(answers)))
        except StopIteration as end:
            outputs.update(end.value)

    for run in runs:
        advance(run, None)
    stage = 0
    while open_:
        now, open_ = open_, []
        kept, got, name = df.columns, {}, f"_w{stage}"
        for k, solve in enumerate(dict.fromkeys(a.solve for _, asks in now for a in asks)):
            some = [a for _, asks in now for a in asks if a.solve is solve]
            df, found = solve(df, some, series, f"{name}{'abcdefgh'[k]}", rows)
            got |= {id(a): x for a, x in zip(some, found)}
        every = [a for _, asks in now for a in asks]
        df = df.select(*[f"`{c}`" for c in kept], F.array(*[got[id(a)] for a in every]).alias(name))
        place = iter(range(len(every)))
        for run, asks in now:
            advance(run, [F.get(name, F.lit(next(place))) for _ in asks])
        stage += 1
    old = [outputs[c].alias(c) if c in outputs else F.col(f"`{c}`") for c in columns]
    return df.select(*old, *[x.alias(c) for c, x in outputs.items() if c not in columns])


def staged(stages: Callable[..., Stages]):
    """The operator on a DataFrame that a generator describes; ``stages`` stays at hand for ``together``."""

    @wraps(stages)
    def add(df: DataFrame, *args, **named) -> DataFrame:
        return together(df, [stages(*args, **named)])

    add.stages = stages
    return add
