"""Toxicity scores by a counterfactually regularised classifier.

A document is the set of its words and of the beginnings (``PREFIXES`` bytes) of longer words; the score is a logistic
regression over those that tell labels apart. For labelled
texts that name a group of people, a twin is made by swapping every identity term, with its beginnings, for the next one
of its kind and language. The loss adds the squared change of the score between a text and its twin, so naming a group
neither raises nor lowers it.

Word counts come from every row of the training sample. The sample is the ``SAMPLE_ROWS`` labelled rows with the smallest
hash of their id, or all if there are fewer: a documented bound, by which the sample may be sent to all tasks and the fit
runs on the driver. Scoring is one pass over the texts with a table of at most ``FEATURES`` weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basecov.llm.frames import mapped, with_batch_columns
from basecov.llm.words import NOT_ALNUM_TABLE, Words, pieces, prefix_keys
from basecov.session import stored

SAMPLE_ROWS = 50_000
FEATURES = 2_048
MIN_CHI2 = 25.0
PREFIXES = (4, 5, 6, 7, 8)
RIDGE = 0.05
SWAP_PENALTY = 10.0
#: Identity terms by language and kind; a swap goes to the next term of the row. No term is in two rows. Fixed values.
IDENTITY_TERMS = {
    "en": (
        ("women", "men"),
        ("woman", "man"),
        ("girls", "boys"),
        ("girl", "boy"),
        ("female", "male"),
        ("mothers", "fathers"),
        ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
        ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"),
        ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
        ("gay", "straight", "lesbian", "bisexual", "queer", "heterosexual"),
        ("transgender", "cisgender"),
        ("immigrants", "citizens", "refugees", "natives"),
        ("immigrant", "citizen", "refugee", "native"),
        ("old", "young"),
        ("elderly", "teenage"),
        ("disabled", "blind", "deaf", "paralyzed"),
        ("american", "mexican", "chinese", "indian", "russian", "german", "french", "spanish"),
    ),
    "de": (
        ("frauen", "männer"),
        ("frau", "mann"),
        ("mädchen", "jungen"),
        ("mütter", "väter"),
        ("christen", "muslime", "juden", "buddhisten", "atheisten"),
        ("christlich", "muslimisch", "jüdisch", "buddhistisch"),
        ("schwarze", "weiße", "asiaten", "afrikaner", "araber"),
        ("schwule", "lesben", "heterosexuelle", "bisexuelle"),
        ("einwanderer", "einheimische", "flüchtlinge"),
        ("behinderte", "gehörlose"),
        ("amerikaner", "chinesen", "inder", "russen", "türken", "polen", "franzosen"),
    ),
    "fr": (
        ("femmes", "hommes"),
        ("femme", "homme"),
        ("filles", "garçons"),
        ("mères", "pères"),
        ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"),
        ("chrétien", "musulman", "juif", "hindou", "bouddhiste"),
        ("noirs", "blancs", "asiatiques", "africains", "arabes"),
        ("homosexuels", "hétérosexuels", "bisexuels"),
        ("immigrés", "citoyens", "réfugiés"),
        ("handicapés", "aveugles", "sourds"),
        ("américains", "chinois", "indiens", "russes", "allemands", "espagnols"),
    ),
    "es": (
        ("mujeres", "hombres"),
        ("mujer", "hombre"),
        ("niñas", "niños"),
        ("madres", "padres"),
        ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
        ("cristiano", "musulmán", "judío", "hindú", "budista"),
        ("negros", "blancos", "asiáticos", "africanos", "árabes"),
        ("homosexuales", "heterosexuales", "bisexuales"),
        ("inmigrantes", "ciudadanos", "refugiados"),
        ("discapacitados", "ciegos", "sordos"),
        ("americanos", "mexicanos", "chinos", "rusos", "alemanes", "franceses"),
    ),
}


def word_keys(words: list[str]) -> np.ndarray:
    return _features_of(words)[0]


def _features_of(words: list[str]) -> list[np.ndarray]:
    """Keys of single words and of their beginnings, aligned with the words."""
    found = [_features(w) for w in pieces(pa.array(words), NOT_ALNUM_TABLE, lower=True)]
    return [np.concatenate(column) for column in zip(*found)]


def _swaps() -> tuple[np.ndarray, list[np.ndarray]]:
    """Keys of all identity terms, sorted, and the features of the word that each is swapped for."""
    rows = [row for language in IDENTITY_TERMS.values() for row in language]
    terms = [t for row in rows for t in row]
    following = [row[(i + 1) % len(row)] for row in rows for i in range(len(row))]
    keys, others = word_keys(terms), _features_of(following)
    order = np.argsort(keys)
    return keys[order], [column[order] for column in others]


def _features(w: Words) -> list[np.ndarray]:
    """Keys of the words of a piece and of their beginnings, aligned with the words; 0 stands for none."""
    return [w.key, *prefix_keys(w.data, w.start, w.end, PREFIXES, lower=True)]


def _distinct(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    return doc[new], key[new]


def _per_document(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each document of a piece: document, key."""
    return _together(w.doc(), _features(w))


def _together(doc: np.ndarray, features: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    pairs = [(doc[k > 0], k[k > 0]) for k in features]
    return _distinct(np.concatenate([d for d, _ in pairs]), np.concatenate([k for _, k in pairs]))


@dataclass
class Model:
    keys: np.ndarray  # sorted
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.likely = np.zeros(1 << 16, bool)
        self.likely[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def scores(self, w: Words) -> np.ndarray:
        docs, features = [], []
        for key in _features(w) if len(self.keys) else []:
            at = np.flatnonzero(self.likely[(key & np.uint64(0xFFFF)).astype(np.int64)])
            feature = _find(self.keys, key[at])
            docs.append(np.searchsorted(w.first, at[feature >= 0], side="right") - 1)
            features.append(feature[feature >= 0])
        doc, feature = np.concatenate(docs or [np.empty(0, np.int64)]), np.concatenate(features or [np.empty(0, np.int64)])
        doc, feature = np.divmod(np.unique(doc * np.int64(max(1, len(self.keys))) + feature), max(1, len(self.keys)))
        total = np.bincount(doc, self.weights[feature], w.n_docs) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places in sorted ``keys``, -1 where absent."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def training_rows(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic) of the sample: labelled rows outside the held-out fifth, the smallest hashes of their ids first."""
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(~held_out("doc_id"))
    chosen = known.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample_rows)
    return docs.join(F.broadcast(chosen), docs.doc_id == F.col("__id")).select("text", "toxic")


def held_out(doc_id: str):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def _counts(rows: DataFrame) -> DataFrame:
    """Texts of either label that hold a word; each batch sends every word once."""

    def compute(batch):
        label = batch.column(1).to_numpy(zero_copy_only=False)
        for w in pieces(batch.column(0), NOT_ALNUM_TABLE, lower=True):
            doc, key = _per_document(w)
            keys, place = np.unique(key, return_inverse=True)
            toxic = np.bincount(place, label[w.row + doc], len(keys)).astype(np.int64)
            yield [keys.view(np.int64), toxic, np.bincount(place, minlength=len(keys)) - toxic]

    found = mapped(rows, [("text", "string"), ("toxic", "int")], [("key", "bigint"), ("pos", "bigint"), ("neg", "bigint")], compute)
    return found.groupBy("key").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def choose_features(rows: DataFrame, *, features: int = FEATURES) -> np.ndarray:
    """Sorted keys of the words with the largest chi-squared, and of all identity terms."""
    pos, neg = rows.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    pos, neg = float(pos or 0), float(neg or 0)
    chi2 = F.expr(f"({pos + neg}D) * pow(pos * ({neg}D - neg) - neg * ({pos}D - pos), 2) / (({pos * neg + 1e-9}D) * (pos + neg) * ({pos + neg}D - pos - neg + 0.5D))")
    best = _counts(rows).withColumn("chi2", chi2).where(F.col("chi2") >= MIN_CHI2).orderBy(F.desc("chi2"), "key").limit(features).select("key").collect()
    return np.union1d(np.array([r[0] for r in best], np.int64).view(np.uint64), _swaps()[0])


def _examples(rows: DataFrame, keys: np.ndarray) -> DataFrame:
    """Per text its features, those of its twin (missing if no identity term occurs) and its label."""
    terms, others = _swaps()

    def compute(batch):
        for w in pieces(batch.column(0), NOT_ALNUM_TABLE, lower=True):
            words, features = w.doc(), _features(w)
            term = _find(terms, w.key)
            touched = np.bincount(words[term >= 0], minlength=w.n_docs) > 0
            twin = [np.where(term >= 0, o[np.maximum(term, 0)], k) for o, k in zip(others, features)]
            sides = []
            for d, k in (_together(words, features), _together(words, twin)):
                feature = _find(keys, k)
                bounds = np.searchsorted(d, np.arange(w.n_docs + 1))
                sides.append([np.unique(f[f >= 0]).astype(np.int32).tobytes() for f in (feature[a:b] for a, b in zip(bounds[:-1], bounds[1:]))])
            yield [pa.array(sides[0], pa.binary()), pa.array([s if n else None for s, n in zip(sides[1], touched)], pa.binary()), batch.column(1).slice(w.row, w.n_docs)]

    return mapped(rows, [("text", "string"), ("toxic", "int")], [("features", "binary"), ("twin", "binary"), ("toxic", "int")], compute)


class _Sparse:
    """0/1 rows given by lists of columns, with signs."""

    def __init__(self, rows: list[np.ndarray], signs: list[np.ndarray] | None, width: int):
        self.n, self.width = len(rows), width
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.column = np.concatenate(rows).astype(np.int64) if rows else np.empty(0, np.int64)
        self.value = np.concatenate(signs) if signs else np.ones(len(self.column))

    def dot(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, v[self.column] * self.value, self.n)

    def back(self, u: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, u[self.row] * self.value, self.width)


def fit(features: list[np.ndarray], twins: list[np.ndarray | None], labels: np.ndarray, width: int, *, ridge: float = RIDGE, swap_penalty: float = SWAP_PENALTY) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton steps; each step is solved by conjugate gradients.

    Loss: log loss + ridge / 2 * |weights|^2 + swap_penalty * sum over twins of (change of the score)^2.
    """
    x = _Sparse([np.append(f, width) for f in features], None, width + 1)
    changed = [(f, t) for f, t in zip(features, twins) if t is not None]
    d = _Sparse([np.concatenate([np.setdiff1d(f, t), np.setdiff1d(t, f)]) for f, t in changed], [np.concatenate([np.ones(len(np.setdiff1d(f, t))), -np.ones(len(np.setdiff1d(t, f)))]) for f, t in changed], width + 1)
    decay = np.append(np.full(width, ridge), 1e-3)
    y = labels.astype(float)

    def loss(v: np.ndarray) -> float:
        z = x.dot(v)
        return float(np.logaddexp(0, z).sum() - (y * z).sum() + (decay * v * v).sum() / 2 + swap_penalty * (d.dot(v) ** 2).sum())

    v = np.zeros(width + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x.dot(v)))
        gradient = x.back(p - y) + decay * v + 2 * swap_penalty * d.back(d.dot(v))
        if np.abs(gradient).max() < 1e-6 * max(1, len(y)):
            break
        curve = p * (1 - p)
        step, rest = np.zeros_like(v), -gradient
        way, size = rest.copy(), float(rest @ rest)
        for _ in range(50):
            image = x.back(curve * x.dot(way)) + decay * way + 2 * swap_penalty * d.back(d.dot(way))
            along = size / float(way @ image)
            step += along * way
            rest -= along * image
            new = float(rest @ rest)
            if new < 1e-10 * max(size, 1e-12) or new < 1e-14:
                break
            way, size = rest + way * (new / size), new
        now, length = loss(v), 1.0
        while loss(v + length * step) > now and length > 1e-6:
            length /= 2
        v = v + length * step
    return v[:-1], float(v[-1])


def train(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, features: int = FEATURES, swap_penalty: float = SWAP_PENALTY) -> Model:
    """A model from documents (doc_id, text) and labels (doc_id, toxic).

    Labels other than 0 and 1, missing ids and rows of the held-out fifth are not used; a missing text is empty; repeated
    rows count as often as they occur. Without usable labels all scores are 0.5.
    """
    rows = stored(training_rows(docs, labels, sample_rows=sample_rows), "toxicity-sample")
    keys = choose_features(rows, features=features)
    held = _examples(rows, keys).toPandas()
    if not len(held):
        return Model(keys, np.zeros(len(keys)), 0.0)
    features_of = [np.frombuffer(b, np.int32) for b in held["features"]]
    twins = [None if b is None else np.frombuffer(b, np.int32) for b in held["twin"]]
    weights, bias = fit(features_of, twins, held["toxic"].to_numpy(), len(keys), swap_penalty=swap_penalty)
    return Model(keys, weights, bias)


def score(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) of every whole text.

    A missing or empty text has the score of a text without words. Columns with those names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(column):
        for w in pieces(column, NOT_ALNUM_TABLE, lower=True):
            scores = shared.value.scores(w)
            yield [pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))]

    return with_batch_columns(docs, text, [("score", "double"), ("predicted", "int")], compute)
