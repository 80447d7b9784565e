"""Mixing sources to target weights by soft membership, in DataFrame operations only.

A classifier fitted on a labelled table reads a few small integer signals from every document
and so gives it a posterior over domains. Then nonnegative rates, one for each document, are
fitted by distributed projected-gradient least squares so that the expected token total of each
domain (rate x tokens x posterior) meets its target.

The signals take at most ``CELLS`` joint values. Documents in the same cell have the same
posterior, hence the same gradient and, from the same start, the same rate. So tokens are added
up by cell once, over all documents, which is exact, and every step is an aggregation over the
table of cells, whose size does not depend on the corpus. The residuals are weighted by the
inverse of the domains' token-weighted Gram matrix; in that norm the largest curvature is 1, so
that a step of 1 is safe and rare domains move as fast as frequent ones.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Scratch

DOMAINS = ("clean", "junk", "toxic")
#: Wanted shares of the mixture's tokens.
TARGETS = {"clean": 0.90, "junk": 0.04, "toxic": 0.06}
#: Bounds of the classifier's fit: labelled rows, and terms kept for a domain.
MAX_TRAIN_ROWS = 20_000
TERMS = 256
MIN_DOCS = 4
PREFIX = 5
#: Signals and how many values each takes; their product bounds the table of cells.
SIGNALS = {**{f"hits_{d}": 5 for d in DOMAINS}, "signs": 4, "fresh": 5, "length": 3}
CELLS = math.prod(SIGNALS.values())
#: Labelled rows that the classifier's own posterior counts for in a cell.
PRIOR_ROWS = 4.0
MAX_STEPS = 200
#: Steps in a row that may bring less than a thousandth.
PATIENCE = 10
TOLERANCE = 1e-4


def domain_of(quality: Column, toxic: Column) -> Column:
    """Name of a labelled row's domain; null unless both labels are 0 or 1."""
    known = quality.isin(0, 1) & toxic.isin(0, 1)
    return F.when(known & (toxic == 1), "toxic").when(known & (quality == 0), "junk").when(known, "clean")


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def _beginning(word: Column) -> Column:
    return F.concat(F.substring(word, 1, PREFIX), F.lit("~"))


def _among(items: Column, wanted: Sequence[str]) -> Column:
    """The items that are in a list of constants, which Spark keeps as one hash set."""
    return F.filter(items, lambda x: x.isin(list(wanted)))


def terms(tokens: Column) -> Column:
    """Distinct words and word beginnings."""
    return F.array_distinct(F.concat(tokens, F.transform(tokens, _beginning)))


def signals(docs: DataFrame, keep: Sequence[str], text_col: str, listed: Mapping[str, Sequence[str]]) -> DataFrame:
    """``keep``, ``n_tokens`` and the SIGNALS of each text: small integers for the hits on each
    domain's terms, signs, repetition and length. What several signals use is a column of its
    own first, so that it is computed once; terms are looked up among the distinct tokens only.
    """
    every = sorted({t for own in listed.values() for t in own})
    whole, starts = [t for t in every if t[-1] != "~"], [t for t in every if t[-1] == "~"]
    none = F.array().cast("array<string>")
    d = docs.select(*keep, F.col(text_col).alias("_text"), words(F.col(text_col)).alias("_tokens"))
    signs = F.regexp_count(F.coalesce("_text", F.lit("")), F.lit("[#*$%&|<>!]"))
    d = d.select(*keep, F.size("_tokens").alias("_n"), signs.alias("_signs"), F.array_distinct("_tokens").alias("_distinct"))
    found = F.concat(_among(F.col("_distinct"), whole) if whole else none, _among(F.transform("_distinct", _beginning), starts) if starts else none)
    n = F.greatest("_n", F.lit(1))
    d = d.select(*keep, "_n", (F.col("_signs") / n).alias("_signs"), (F.size("_distinct") / n).alias("_fresh"), F.array_distinct(found).alias("_found"))
    out = {}
    for domain in DOMAINS:
        own = listed.get(domain)
        out[f"hits_{domain}"] = F.least(F.size(_among(F.col("_found"), own)), F.lit(4)) if own else F.lit(0)
    signs, fresh, n = F.col("_signs"), F.col("_fresh"), F.col("_n")
    out["signs"] = F.when(signs == 0, 0).when(signs < 0.2, 1).when(signs < 0.8, 2).otherwise(3)
    out["fresh"] = F.when(fresh < 0.25, 0).when(fresh < 0.4, 1).when(fresh < 0.55, 2).when(fresh < 0.7, 3).otherwise(4)
    out["length"] = F.when(n < 20, 0).when(n < 200, 1).otherwise(2)
    return d.select(*keep, n.cast("long").alias("n_tokens"), *(c.alias(f"_signal_{k}") for k, c in out.items()))


class DomainClassifier:
    """Naive Bayes over ``signals``, calibrated by cell.

    About MAX_TRAIN_ROWS labelled rows, chosen by a hash of their id, are used. Terms are chosen
    on one half of them; weights and cell counts come from the other, on which chosen terms look
    no better than they are. A cell's posterior is its labelled rows' shares, shrunk toward the
    naive Bayes one as if that were PRIOR_ROWS rows.
    """

    def __init__(self, docs: DataFrame, labels: DataFrame, scratch: Scratch, text_col: str = "text", id_col: str = "doc_id") -> None:
        known = labels.select(F.col(id_col).alias("label_id"), domain_of(F.col("quality"), F.col("toxic")).alias("domain")).where("domain IS NOT NULL AND label_id IS NOT NULL")
        n = known.count()
        if n > MAX_TRAIN_ROWS:
            known = known.where(F.pmod(F.xxhash64(F.col("label_id").cast("string"), F.lit("mixing")), F.lit(1_000_000)) < int(MAX_TRAIN_ROWS / n * 1_000_000))
        texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        half = F.pmod(F.xxhash64(F.col("label_id").cast("string"), F.lit("half")), F.lit(2))
        labelled = texts.join(F.broadcast(known), F.col("id") == F.col("label_id"))  # MAX_TRAIN_ROWS labels, about
        sample = scratch.save(labelled.select("domain", "text", half.alias("half")))
        sizes = {(r["domain"], r["half"]): r["n"] for r in sample.groupBy("domain", "half").agg(F.count("*").alias("n")).collect()}
        total = sum(sizes.get((d, 0), 0) for d in DOMAINS)
        exploded = sample.where("half = 0").select("domain", F.explode(terms(words(F.col("text")))).alias("term"))
        counted = exploded.groupBy("term").agg(F.count("*").alias("n"), *(F.count(F.when(F.col("domain") == d, 1)).alias(d) for d in DOMAINS))
        counts = scratch.save(counted.where(F.col("n") >= MIN_DOCS))
        self.listed: dict[str, list[str]] = {}
        for d in DOMAINS:
            share = sizes.get((d, 0), 0) / max(1, total)
            lift = (F.col(d) + share) / (F.col("n") + 1) / max(share, 1e-9)
            gain = F.col(d) * F.log(lift)
            best = counts.where(lift > 3).orderBy(F.desc(gain), "term").limit(TERMS) if 0 < share < 0.5 else counts.limit(0)
            self.listed[d] = sorted(r["term"] for r in best.select("term").collect())
        marked = self._marked(sample.where("half = 1"), ("domain",), "text")
        self.cells = scratch.save(marked.groupBy("cell").agg(*(F.count(F.when(F.col("domain") == d, 1)).alias(f"rows_{d}") for d in DOMAINS)))  # at most CELLS rows
        pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), self._signal(k).alias("v")) for k in SIGNALS))).alias("p")
        seen = self.cells.select(*(f"rows_{d}" for d in DOMAINS), pairs).groupBy("p.k", "p.v").agg(*(F.sum(f"rows_{d}").alias(d) for d in DOMAINS)).collect()
        at = {(d, r["k"], r["v"]): r[d] for r in seen for d in DOMAINS}
        mine = {d: sizes.get((d, 1), 0) for d in DOMAINS}
        self.known = len([d for d in DOMAINS if mine[d]])
        self.prior = {d: math.log((mine[d] + 0.5) / (sum(mine.values()) + 0.5 * len(DOMAINS))) for d in DOMAINS}
        for table in (0, 1):  # the labelled texts and their terms; the table of cells is read later
            scratch.drop(table)
        self.weight = {(d, k): [math.log((at.get((d, k, v), 0) + 0.5) / (mine[d] + 0.5 * width)) for v in range(width)] for d in DOMAINS for k, width in SIGNALS.items()}

    @staticmethod
    def _signal(name: str) -> Column:
        """The value of one signal in ``cell``, whose digits the signals are."""
        low = 1
        for k, width in SIGNALS.items():
            if k == name:
                return F.pmod(F.floor(F.col("cell") / low), F.lit(width)).cast("int")
            low *= width
        raise KeyError(name)

    def _marked(self, docs: DataFrame, keep: Sequence[str], text_col: str) -> DataFrame:
        read = signals(docs, keep, text_col, self.listed)
        cell, low = F.lit(0), 1
        for k, width in SIGNALS.items():
            cell = cell + F.col(f"_signal_{k}") * low
            low *= width
        return read.select(*keep, "n_tokens", cell.cast("int").alias("cell"))

    def mark(self, docs: DataFrame, keep: Sequence[str], text_col: str = "text") -> DataFrame:
        """``keep`` columns, ``n_tokens`` long and ``cell`` int of every row: one pass over the texts."""
        return self._marked(docs, keep, text_col)

    def posteriors(self, cells: DataFrame) -> DataFrame:
        """``cells`` (at most CELLS rows, one a cell) with ``p_<domain>`` double."""
        logs = []
        for d in DOMAINS:
            score = F.lit(self.prior[d])
            for k in SIGNALS:
                score = score + F.element_at(F.array(*map(F.lit, self.weight[d, k])), self._signal(k) + 1)
            logs.append(score.alias(f"_log_{d}"))
        top = F.greatest(*(F.col(f"_log_{d}") for d in DOMAINS))
        own = cells.columns
        raw = cells.select("*", *logs).select(*own, *(F.exp(F.col(f"_log_{d}") - top).alias(f"_raw_{d}") for d in DOMAINS))
        whole = sum((F.col(f"_raw_{d}") for d in DOMAINS), F.lit(0.0))
        seen = self.cells.select(F.col("cell").alias("_seen_cell"), *(F.col(f"rows_{d}") for d in DOMAINS))
        both = raw.join(F.broadcast(seen), F.col("cell") == F.col("_seen_cell"), "left")  # at most CELLS rows
        rows = {d: F.coalesce(F.col(f"rows_{d}"), F.lit(0)) for d in DOMAINS}
        n = sum(rows.values(), F.lit(0))
        return both.select(*own, *(((rows[d] + PRIOR_ROWS * F.col(f"_raw_{d}") / whole) / (n + PRIOR_ROWS)).alias(f"p_{d}") for d in DOMAINS))


def rate_column(steps: Sequence[Sequence[float]], cap: float | None, least: Column | None = None) -> Column:
    """The rate after all steps: start at 1, move, project onto [``least`` or 0, ``cap``], and so on."""
    if not steps:
        return F.lit(1.0)
    p = [F.col(f"p_{d}") for d in DOMAINS]

    def moved(rate: Column, step: Column) -> Column:
        new = rate - sum((x * step[i] for i, x in enumerate(p)), F.lit(0.0))
        low = F.greatest(F.lit(0.0) if least is None else least, new)
        return low if cap is None else F.least(F.lit(float(cap)), low)

    text = ",".join(f"[{','.join(repr(float(m)) for m in step)}]" for step in steps)  # one literal, however many steps
    return F.reduce(F.from_json(F.lit(f"[{text}]"), "array<array<double>>"), F.lit(1.0), moved)


@dataclass
class Fit:
    """Multipliers of each projected-gradient step, and what the rates reach."""

    steps: list[list[float]]
    wanted: dict[str, float]
    held: dict[str, float]

    def missed(self) -> float:
        """The largest miss of a domain's target, as a share of all wanted tokens."""
        whole = sum(self.wanted.values())
        return max((abs(self.held[d] - self.wanted[d]) for d in DOMAINS), default=0.0) / whole if whole else 0.0


def fit_rates(cells: DataFrame, targets: Mapping[str, float], total: float | None = None, cap: float | None = None, least: Column | None = None) -> Fit:
    """Projected-gradient steps over a table with ``n_tokens`` and ``p_<domain>``, one row a cell or document.

    Minimises (E - T)' G^-1 (E - T) over rates >= ``least`` or 0 (and <= ``cap``), where E are the domains'
    expected tokens, T the targets and G the token-weighted Gram matrix of the posteriors, in the
    norm weighted by tokens. There the largest curvature is 1, so a step of 1 never climbs; a step
    is longer where the last move found less curvature (most rates at a bound). ``total``: tokens of the mixture; the table's own by
    default. Stops within TOLERANCE of all targets, when steps no longer help, or after
    MAX_STEPS; a miss of more than 1 % of all tokens is warned of. One small aggregation a step.
    """
    p = {d: F.col(f"p_{d}") for d in DOMAINS}
    n = F.col("n_tokens")
    grid = [F.sum(n * p[a] * p[b]).alias(f"{a}_{b}") for a in DOMAINS for b in DOMAINS]
    first = cells.agg(F.sum(n).alias("n"), *(F.sum(n * p[d]).alias(d) for d in DOMAINS), *grid).first()
    if not first["n"]:
        return Fit([], dict.fromkeys(DOMAINS, 0.0), dict.fromkeys(DOMAINS, 0.0))
    whole = float(first["n"]) if total is None else total
    wanted = {d: targets.get(d, 0.0) * whole for d in DOMAINS}
    held = {d: float(first[d]) for d in DOMAINS}
    gram = np.array([[float(first[f"{a}_{b}"]) for b in DOMAINS] for a in DOMAINS])
    inverse = np.linalg.pinv(gram, rcond=1e-9, hermitian=True)
    out = Fit([], wanted, held)
    losses: list[float] = []
    size, slow = 1.0, 0
    while len(out.steps) < MAX_STEPS:
        off = np.array([out.held[d] - wanted[d] for d in DOMAINS])
        losses.append(float(off @ inverse @ off))
        slow = slow + 1 if len(losses) > 1 and losses[-1] >= min(losses[:-1]) * (1 - 1e-3) else 0
        if out.missed() <= TOLERANCE or slow >= PATIENCE:
            break
        before = out.held
        for size in (size, 1.0):  # a long step that climbs above the last losses is taken back
            trial = [*out.steps, (size * (inverse @ off)).tolist()]
            rate = F.struct(rate_column(out.steps, cap, least).alias("old"), rate_column(trial, cap, least).alias("new"))
            moved = n * F.pow(F.col("_rate.new") - F.col("_rate.old"), 2)
            row = cells.select(n, *p.values(), rate.alias("_rate")).agg(F.sum(moved).alias("_moved"), *(F.sum(F.col("_rate.new") * n * p[d]).alias(d) for d in DOMAINS)).first()
            new = {d: float(row[d]) for d in DOMAINS}
            rest = np.array([new[d] - wanted[d] for d in DOMAINS])
            if size <= 1 or float(rest @ inverse @ rest) <= max(losses[-5:]):
                break
        out.steps, out.held = trial, new
        change = np.array([new[d] - before[d] for d in DOMAINS])
        curved = float(change @ inverse @ change)
        size = min(1e4, max(1.0, float(row["_moved"]) / curved)) if curved > 0 else 1.0  # the curvature along the last move
    if out.missed() > 0.01:
        warnings.warn(f"mixture misses a target by {out.missed():.1%} of its tokens: the posteriors and bounds allow no better", stacklevel=2)
    return out


def _members(model: DomainClassifier, marked: DataFrame, scratch: Scratch) -> DataFrame:
    """Tokens by cell, over all rows of ``marked``, with posteriors: at most CELLS rows."""
    return scratch.save(model.posteriors(marked.groupBy("cell").agg(F.sum("n_tokens").alias("n_tokens"))))


def _with_cells(marked: DataFrame, cells: DataFrame, columns: Sequence[Column | str]) -> DataFrame:
    found = cells.select(F.col("cell").alias("_cell"), *columns)
    return marked.join(F.broadcast(found), F.col("cell") == F.col("_cell")).drop("cell", "_cell")  # at most CELLS rows


def mix(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS, total: float | None = None, cap: float | None = None, keep: Sequence[str] = ("doc_id",), text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``keep`` columns, ``n_tokens``, ``p_<domain>`` and ``rate`` (double, >= 0) of every row.

    Null and empty texts have no tokens, so any rate suits them; they get one from the same steps.
    Without labels all posteriors are equal and no step can bring the targets nearer one by one;
    the rates are then all alike. Repeated rows and null ids count as often as they stand; a label
    without a document or with a null isn't used. An empty table gives an empty result; other
    columns are not read. ``keep`` may not name a result column.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    model = DomainClassifier(docs, labels, scratch, text_col, id_col)
    marked = scratch.save(model.mark(docs, keep, text_col))
    cells = _members(model, marked, scratch)
    fit = fit_rates(cells, targets, total, cap)
    return _with_cells(marked, cells, [*(f"p_{d}" for d in DOMAINS), rate_column(fit.steps, cap).alias("rate")])


def mixed_rows(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS, text_col: str = "text", id_col: str = "doc_id", sure: float = 0.9) -> DataFrame:
    """The rows of ``docs`` that a mixture without repetition keeps; all their columns.

    The mixture is as large as the domain with the largest target can fill at rate 1. Rows that
    belong to this domain more likely than not stay at rate 1, so that targets out of reach cost
    it nothing; the rates of all others are fitted between 0 and 1. A row stays if its rate is
    ``sure`` or more, else with the probability rate / sure by a hash of its id. Without labels of two domains at least nothing tells the domains apart, and every row
    stays; so it does where no target is positive. Equal rows share a draw, null ids draw as the
    empty id, null and empty texts are weighed by their cell like others. An empty table gives
    an empty result. Columns of any name pass through as they are.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    model = DomainClassifier(docs, labels, scratch, text_col, id_col)
    favoured = max(DOMAINS, key=lambda d: targets.get(d, 0.0))
    if model.known < 2 or targets.get(favoured, 0.0) <= 0:
        return docs
    own = docs.columns
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("_row"), F.col(text_col).alias("_mixed_text"), F.col(id_col).cast("string").alias("_mixed_id"))
    new = {c: c for c in ("_mixed_id", "n_tokens", "cell")}  # names that no column of the table has
    while taken := [k for k, c in new.items() if c.lower() in map(str.lower, own)]:
        new |= {k: f"_{new[k]}" for k in taken}
    marked = model.mark(row, ("_row", "_mixed_id"), "_mixed_text")
    rows = scratch.save(marked.select("_row.*", *(F.col(k).alias(c) for k, c in new.items())))
    marks = rows.select(*(F.col(c).alias(k) for k, c in new.items()))
    cells = _members(model, marks, scratch)
    whole = cells.agg(F.sum(F.col("n_tokens") * F.col(f"p_{favoured}")).alias("n")).first()["n"]
    spared = F.when(F.col(f"p_{favoured}") >= 0.5, 1.0).otherwise(0.0)
    fit = fit_rates(cells, targets, float(whole or 0.0) / targets[favoured], 1.0, spared)
    rates = cells.select(F.struct("cell", rate_column(fit.steps, 1.0, spared).alias("rate")).alias("_found"))
    draw = F.pmod(F.xxhash64(F.coalesce(F.col(new["_mixed_id"]), F.lit("")), F.lit("draw")), F.lit(1_000_000)) / 1_000_000
    # at most CELLS rows, which find rows by their cell and never take columns with them
    kept = rows.join(F.broadcast(rates), (F.col(new["cell"]) == F.col("_found.cell")) & (F.col("_found.rate") > draw * sure), "left_semi")
    return kept.select(*(F.col(f"`{c}`") for c in own))
