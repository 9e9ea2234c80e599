"""Language identification in two steps: the family first, then closely related languages against each other.

A text is turned into counts of its letter 1-, 2- and 3-grams (lower-cased, all else one blank), hashed into
``DIMENSIONS`` bins, whose square roots are scaled to length one. A family is chosen by one-versus-rest linear support
vector machines over families; within it, each pair of languages has a machine of its own, and the language with the
most (then the clearest) wins is taken. Machines minimise squared hinge loss in numpy. Margins become probabilities by a
logistic curve fitted to the training margins; the score is the family's probability times the weakest win's.

The model is fitted on a bounded sample of labelled rows: at most ``rows`` in all and ``per_language`` of each value of
``lang``, fewer of each as languages grow in number (with more languages than ``rows``, languages are drawn too). Rows are
drawn by a hash of id and text. What reaches the driver are these rows' features, never texts. Prediction is one narrow
pass over whole texts.

Families of known language codes are fixed; an unknown code is a family of its own. Rows with null ``lang`` don't
train. Null and empty texts and texts without letters are ``und`` with score 0, as is all if nothing was learned. Repeated
rows are predicted each for itself and count once in the sample. Very long texts are read in slices, whole. An empty table
gives no rows. Only text decides: ``lang``, ``source`` and ids are no input of a prediction. Other columns are ignored by
``predict`` and passed through by ``identified``.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import decoded, map_rows, stored, text_bytes

UND = "und"
DIMENSIONS = 8192
#: Labelled rows that the model is fitted on: of each language, and in all.
PER_LANGUAGE = 300
ROWS = 12_000
#: Families that are trained at once, and characters of a text that are read at once.
TOGETHER = 64
SLICE_CHARS = 1 << 20
#: Families of common languages.
FAMILIES = {
    "germanic": "en de nl af da no nb nn sv is fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "indic": "hi bn mr gu pa ur ne",
    "semitic": "ar he mt am",
}
FAMILY_OF = {lang: name for name, langs in FAMILIES.items() for lang in langs.split()}


def family_of(lang: str) -> str:
    return FAMILY_OF.get(lang.lower().replace("_", "-").split("-")[0], lang)


@functools.lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Code points of the basic plane: letters and marks as they are, all else blank."""
    return np.array([c if (ch := chr(c)).isalpha() or 0x300 <= c < 0x370 else 32 for c in range(0x10000)], dtype=np.uint64)


@functools.lru_cache(maxsize=1)
def is_letter() -> np.ndarray:
    """Of each code point whether it's a letter; marks aren't, though they count in n-grams beside letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _tally(counts: np.ndarray, c: np.ndarray, fresh: int) -> None:
    """Add the 1-, 2- and 3-grams that end in the last ``fresh`` codes."""
    one = c * np.uint64(0x9E3779B97F4A7C15)
    two = (one[:-1] ^ (c[1:] * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0xFF51AFD7ED558CCD)
    three = (two[:-1] ^ (c[2:] * np.uint64(0x165667B19E3779F9))) * np.uint64(0xC4CEB9FE1A85EC53)
    for h in (one * np.uint64(0xFF51AFD7ED558CCD), two, three):
        counts += np.bincount((h[max(0, len(h) - fresh) :] >> np.uint64(51)).astype(np.int64), minlength=DIMENSIONS)


def features(text: str) -> np.ndarray | None:
    """Scaled n-gram counts; None if the text has no letter. Long texts are read in slices; the last two codes are kept
    for the n-grams that cross from one to the next."""
    counts = np.zeros(DIMENSIONS)
    tail = np.array([32], dtype=np.uint64)
    _tally(counts, tail, 1)
    letters = False
    for at in range(0, len(text), SLICE_CHARS):
        points = np.frombuffer(text[at : at + SLICE_CHARS].lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        basic = points < 0x10000
        codes = np.where(basic, letter_table()[np.where(basic, points, 0)], points).astype(np.uint64)
        blank = codes == 32
        letters = letters or bool(is_letter()[points].any())
        # runs of blanks count as one
        keep = ~blank
        keep[1:] |= blank[1:] & ~blank[:-1]
        keep[0] |= tail[-1] != 32
        fresh = codes[keep]
        if len(fresh):
            c = np.concatenate([tail, fresh])
            _tally(counts, c, len(fresh))
            tail = c[-2:]
    if not letters:
        return None
    _tally(counts, np.append(tail, np.uint64(32)), 1)
    counts = np.sqrt(counts)
    return (counts / np.linalg.norm(counts)).astype(np.float32)


@dataclass
class Machine:
    """A linear support vector machine with a logistic curve over its margin."""

    weights: np.ndarray
    bias: float
    slope: float = 4.0
    shift: float = 0.0

    def margins(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def train(x: np.ndarray, positive: np.ndarray, cost: float = 20.0, steps: int = 120) -> list[Machine]:
    """A machine for each column of ``positive``: squared hinge loss with an L2 penalty, classes weighted alike, by
    accelerated full gradients of all machines at once."""
    y = np.where(positive, 1.0, -1.0).astype(np.float32)
    n1 = positive.sum(axis=0)
    n0 = len(x) - n1
    share = np.where(positive, 0.5 / np.maximum(1, n1), 0.5 / np.maximum(1, n0)).astype(np.float32)
    w = np.zeros((x.shape[1] + 1, y.shape[1]), dtype=np.float32)  # biases are last
    ahead, momentum = w, 1.0
    # rows have length sqrt(2) at most, so this bounds the curvature
    step = 1.0 / (1.0 / cost + 2 * 2.0)
    for _ in range(steps):
        pull = share * y * np.maximum(0, 1 - y * (x @ ahead[:-1] + ahead[-1]))
        grad = ahead / cost - 2 * np.concatenate([x.T @ pull, pull.sum(axis=0, keepdims=True)])
        nxt = ahead - step * grad
        m = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        ahead = nxt + (momentum - 1) / m * (nxt - w)
        w, momentum = nxt, m
    margins = (x @ w[:-1] + w[-1]).astype(np.float64)
    return [_calibrated(Machine(w[:-1, k].copy(), float(w[-1, k])), margins[:, k], positive[:, k]) for k in range(y.shape[1])]


def _calibrated(machine: Machine, margin: np.ndarray, positive: np.ndarray) -> Machine:
    """The machine with Platt's curve over its margins, with his smoothed targets."""
    n1, n0 = int(positive.sum()), int((~positive).sum())
    goal = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 4.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        d, h = p - goal, np.maximum(p * (1 - p), 1e-6)
        g = np.array([(d * margin).sum(), d.sum()])
        hess = np.array([[(h * margin**2).sum(), (h * margin).sum()], [(h * margin).sum(), h.sum()]]) + 1e-3 * np.eye(2)
        move = np.linalg.solve(hess, g)
        a, b = a - float(np.clip(move[0], -5, 5)), b - float(np.clip(move[1], -5, 5))
    machine.slope, machine.shift = max(a, 0.1), b
    return machine


@dataclass
class Model:
    families: dict[str, list[str]] = field(default_factory=dict)
    rest: dict[str, Machine] = field(default_factory=dict)
    pairs: dict[tuple[str, str], Machine] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> list[tuple[str, float, str | None]]:
        """(language, score, family) of each row of features."""
        if not self.families:
            return [(UND, 0.0, None)] * len(x)
        names = list(self.families)
        if len(names) > 1:
            margins = np.stack([self.rest[f].margins(x) for f in names], axis=1)
            chance = np.stack([self.rest[f].probability(margins[:, i]) for i, f in enumerate(names)], axis=1)
            best = margins.argmax(axis=1)
            sure = chance[np.arange(len(x)), best] / chance.sum(axis=1).clip(1e-9)
        else:
            best, sure = np.zeros(len(x), dtype=int), np.ones(len(x))
        out: list = [None] * len(x)
        for i, name in enumerate(names):
            rows = np.nonzero(best == i)[0]
            if not len(rows):
                continue
            langs = self.families[name]
            wins = np.zeros((len(rows), len(langs)))
            clear = np.zeros((len(rows), len(langs)))
            weakest = np.ones((len(rows), len(langs)))
            for a, b in combinations(range(len(langs)), 2):
                machine = self.pairs[langs[a], langs[b]]
                margin = machine.margins(x[rows])
                p = machine.probability(margin)
                wins[:, a] += margin >= 0
                wins[:, b] += margin < 0
                clear[:, a] += margin
                clear[:, b] -= margin
                weakest[:, a] = np.minimum(weakest[:, a], p)
                weakest[:, b] = np.minimum(weakest[:, b], 1 - p)
            took = np.lexsort((-clear, -wins), axis=1)[:, 0] if len(langs) > 1 else np.zeros(len(rows), dtype=int)
            for r, t in zip(rows.tolist(), range(len(rows)), strict=True):
                k = took[t]
                out[r] = (langs[k], float(np.clip(sure[r] * weakest[t, k], 0, 1)), name)
        return out


def _featurize(rows: Iterator[tuple]) -> Iterator[tuple]:
    for lang, order, text in rows:
        x = features(decoded(text))
        if x is not None:
            at = np.nonzero(x)[0]
            yield lang, order, at.astype("<u2").tobytes(), x[at].astype("<f2").tobytes()


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, rows: int = ROWS) -> DataFrame:
    """lang and features (places and values) of the labelled rows that the model is fitted on."""
    known = docs.select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("string").alias("__id"), text_bytes().alias("__text")).filter("lang IS NOT NULL")
    counts = stored(known.groupBy("lang").agg(F.count("*").alias("__n")))
    languages = counts.count()
    each = max(1, min(per_language, rows // max(1, languages)))
    chosen = counts.orderBy(F.xxhash64("lang"), "lang").limit(rows) if languages > rows else counts  # at most ``rows``, so it can be sent
    order = F.xxhash64("__id", "__text", F.lit(3))
    part = F.pmod(order, F.lit(1 << 30)) / F.lit(float(1 << 30))
    # some more than needed, of which the first stay
    drawn = known.join(F.broadcast(chosen), "lang").filter(part < F.lit(1.3 * each + 10) / F.col("__n"))
    told = map_rows(drawn, [F.col("lang"), order, F.col("__text")], _featurize, "lang string, place long, at binary, x binary")
    told = told.withColumn("__k", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("place", F.lit(1 << 30)), "place", "x"))).filter(F.col("__k") <= each)
    return told.select("lang", "place", "at", "x")


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, rows: int = ROWS) -> Model:
    """Fit on at most ``per_language`` rows (text and non-null lang) of each language, and ``rows`` in all."""
    drawn = sorted(tuple(r) for r in sample(docs, per_language, rows).collect())  # the same, however dealt
    if not drawn:
        return Model()
    langs = np.array([lang for lang, _, _, _ in drawn], dtype=object)
    x = np.zeros((len(drawn), DIMENSIONS), dtype=np.float32)
    for i, (_, _, at, values) in enumerate(drawn):
        x[i, np.frombuffer(at, dtype="<u2")] = np.frombuffer(values, dtype="<f2")
    del drawn
    model = Model()
    for lang in sorted(set(langs)):
        model.families.setdefault(family_of(lang), []).append(lang)
    kin = np.array([family_of(v) for v in langs], dtype=object)
    names = list(model.families)
    for at in range(0, len(names) if len(names) > 1 else 0, TOGETHER):
        some = names[at : at + TOGETHER]
        model.rest.update(zip(some, train(x, np.stack([kin == name for name in some], axis=1)), strict=True))
    for members in model.families.values():
        for a, b in combinations(members, 2):
            rows_ab = (langs == a) | (langs == b)
            (model.pairs[a, b],) = train(x[rows_ab], (langs[rows_ab] == a)[:, None])
    return model


def _predict(model: Model, n: int, rows: Iterator[tuple]) -> Iterator[tuple]:
    held: list[tuple] = []
    xs: list[np.ndarray] = []

    def flush() -> Iterator[tuple]:
        if held:
            for row, found in zip(held, model.predict(np.stack(xs)), strict=True):
                yield *row, *found
            held.clear()
            xs.clear()

    for row in rows:
        x = features(decoded(row[n]))
        if x is None:
            yield *row[:n], UND, 0.0, None
            continue
        held.append(row[:n])
        xs.append(x)
        if len(held) == 256:
            yield from flush()
    yield from flush()


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep``, lang_pred, score and family of every row."""
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "lang_pred string, score double, family string"])
    columns: list[Column] = [F.col(f"`{c}`") for c in keep]
    return map_rows(docs, [*columns, text_bytes()], functools.partial(_predict, model, len(keep)), schema)


def identified(docs: DataFrame, model: Model | None = None, least: float = 0.0) -> DataFrame:
    """The rows of ``docs`` in a known language with at least the given score; their columns stay as they are."""
    model = fit(docs) if model is None else model
    told = predict(docs, model, docs.columns)
    return told.filter((F.col("lang_pred") != UND) & (F.col("score") >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])
