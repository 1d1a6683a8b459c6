"""Operator 7: hierarchical language identification.

First a family is predicted by one linear support vector machine per family against the rest, then one-versus-one
machines among the family's languages vote. Features are hashed byte 2- to 4-grams of the lower-cased text
with everything but letters folded to one blank, square-rooted and scaled to length 1; whole texts count.

Margins only compare learned languages with each other. What is in none of them is told by its evidence: the mean log
ratio of its n-grams' frequencies in a language's sample to even ones. Each language's least evidence comes from its
sample; the score is the machines' or that of the evidence, whichever is lower.

The machines are fitted on the driver on a bounded sample, at most about ``PER_LANGUAGE`` labelled documents
of each language drawn by the hash of their id, sent there as sparse features; of the languages the ``LANGUAGES``
most frequent labels. Prediction is one map over the
scan with a model of fixed size (``BUCKETS`` x machines).

Cases: a text that is null or has no letter is ``und`` with score 0; if there is no labelled row, all are
``und``; a label counts for the family of its primary subtag, in either case and with two or three letters (``pt-BR``, ``EN``,
``eng``), and stays a label of its own; labels whose primary subtag is in no family make one with those that share it;
with one language only, every text with letters is that; repeated rows repeat; a null doc_id stays null, is not held out and not learned from; extra
columns are dropped or kept as they are; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import quoted

#: Labelled documents that are learned from, per language; languages that are learned, those with most documents;
#: feature buckets; passes over the sample.
PER_LANGUAGE, LANGUAGES, BUCKETS, EPOCHS = 300, 64, 8192, 15
UNKNOWN = "und"
#: Documents whose prediction scores lower are rejected by ``accepted``.
LEAST_SCORE = 0.05
#: A language's least evidence is this part of its sample's median, or the sample's low quantile where that is lower.
LEAST_PART, LOW_QUANTILE = 0.1, 0.01
#: N-grams that one text adds to its language's frequencies, at most.
LONG = 10_000

#: Families of languages, by ISO 639-1 code.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tk"),
    "baltic": ("lt", "lv"),
    "celtic": ("ga", "gd", "cy", "br"),
    "indo-aryan": ("hi", "mr", "ne", "bn", "as", "gu", "pa", "ur"),
    "iranian": ("fa", "ps", "ku", "tg"),
    "semitic": ("ar", "he", "mt", "am"),
    "dravidian": ("ta", "te", "kn", "ml"),
    "malayo-polynesian": ("id", "ms", "jv", "su", "tl", "mg"),
    "sinitic": ("zh", "yue", "wuu"),
    "bantu": ("sw", "zu", "xh", "rw", "sn"),
}
#: ISO 639-2 and 639-3 codes of these languages, other than the two letters.
THREE = {
    "eng": "en", "deu": "de", "ger": "de", "nld": "nl", "dut": "nl", "swe": "sv", "dan": "da", "nor": "no", "nob": "nb", "nno": "nn",
    "isl": "is", "ice": "is", "afr": "af", "fry": "fy", "ltz": "lb", "fra": "fr", "fre": "fr", "spa": "es", "ita": "it", "por": "pt",
    "ron": "ro", "rum": "ro", "cat": "ca", "glg": "gl", "oci": "oc", "rus": "ru", "ukr": "uk", "bel": "be", "pol": "pl", "ces": "cs",
    "cze": "cs", "slk": "sk", "slo": "sk", "slv": "sl", "hrv": "hr", "srp": "sr", "bos": "bs", "bul": "bg", "mkd": "mk", "mac": "mk",
    "fin": "fi", "est": "et", "hun": "hu", "tur": "tr", "aze": "az", "kaz": "kk", "uzb": "uz", "kir": "ky", "tuk": "tk", "lit": "lt",
    "lav": "lv", "gle": "ga", "gla": "gd", "cym": "cy", "wel": "cy", "bre": "br", "hin": "hi", "mar": "mr", "nep": "ne", "ben": "bn",
    "asm": "as", "guj": "gu", "pan": "pa", "urd": "ur", "fas": "fa", "per": "fa", "pus": "ps", "kur": "ku", "tgk": "tg", "ara": "ar",
    "heb": "he", "mlt": "mt", "amh": "am", "tam": "ta", "tel": "te", "kan": "kn", "mal": "ml", "ind": "id", "msa": "ms", "may": "ms",
    "jav": "jv", "sun": "su", "tgl": "tl", "mlg": "mg", "zho": "zh", "chi": "zh", "cmn": "zh", "swa": "sw", "zul": "zu", "xho": "xh",
    "kin": "rw", "sna": "sn",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}


def family_of(label: str) -> str:
    """The family of a label; that of its primary subtag's name where no family has it."""
    primary = label.strip().lower().replace("_", "-").split("-")[0]
    code = THREE.get(primary, primary)
    return FAMILY_OF.get(code, code)


_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
#: Buckets of n-grams of blanks only, which tell nothing.
_SHIFT = 32 - (BUCKETS.bit_length() - 1)
_BLANKS = [gram * k % 2**32 >> _SHIFT for gram, k in ((0x2020, 2654435761), (0x202020, 2246822519), (0x20202020, 3266489917))]
#: Buckets and values of a text's features.
Sparse = tuple[np.ndarray, np.ndarray]
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def has_letter(text: str | None) -> bool:
    return bool(text) and (any(map(str.isalpha, text[:64])) or any(map(str.isalpha, text[64:])))


def counts(text: str) -> np.ndarray:
    """Hashed n-gram counts of a text."""
    data = np.frombuffer((" " + text.lower() + "   ").encode().translate(_FOLD), np.uint8).astype(np.uint32)
    two = data[:-1] << 8 | data[1:]
    three = two[:-1] << 8 | data[2:]
    four = three[:-1] << 8 | data[3:]
    buckets = [(x * np.uint32(k)) >> np.uint32(_SHIFT) for x, k in ((two, 2654435761), (three, 2246822519), (four, 3266489917))]
    return np.bincount(np.concatenate(buckets), minlength=BUCKETS)


def scaled(c: np.ndarray) -> Sparse:
    at = np.flatnonzero(c).astype(np.int32)
    v = np.sqrt(c[at], dtype=np.float32)
    return at, v / max(1e-6, float(np.linalg.norm(v)))


def features(text: str) -> Sparse:
    return scaled(counts(text))


def fit_svm(x: list[Sparse], y: np.ndarray, c: float = 10.0, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of a linear SVM with squared hinge loss, by dual coordinate descent. ``y`` is +1 or -1."""
    w, alpha = np.zeros(BUCKETS, np.float32), np.zeros(len(y))
    q = np.array([float(v @ v) for _, v in x]) + 1 / (2 * c)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(y)):
            at, v = x[i]
            g = y[i] * float(v @ w[at]) - 1 + alpha[i] / (2 * c)
            new = max(0.0, alpha[i] - g / q[i])
            if new != alpha[i]:
                w[at] += np.float32((new - alpha[i]) * y[i]) * v
                alpha[i] = new
    return w


def shares(x: Sparse) -> np.ndarray:
    """Shares of a text's buckets, from its features, without those of blanks."""
    at, v = x
    p = np.where(np.isin(at, _BLANKS), 0, v * v)
    return p / max(1e-6, float(p.sum()))


def evidence(x: Sparse, profiles: np.ndarray) -> np.ndarray:
    return shares(x) @ profiles[x[0]]


def profile(x: list[Sparse], sizes: np.ndarray) -> np.ndarray:
    """Log ratios of the buckets' frequencies in a language's sample to even ones; long texts count as ``LONG`` n-grams."""
    seen = np.full(BUCKETS, 0.5)
    for row, n in zip(x, sizes, strict=True):
        seen[row[0]] += min(n, LONG) * shares(row)
    ratios = np.log(seen * (BUCKETS / seen.sum()))
    ratios[_BLANKS] = 0
    return ratios.astype(np.float32)


def least_evidence(x: list[Sparse], sizes: np.ndarray) -> float:
    """What a text needs for a language, from its sample; each half is told by the other one's profile."""
    by_half = [profile(x[k::2], sizes[k::2]) for k in (0, 1)]
    told = [float(evidence(row, by_half[1 - i % 2])) for i, row in enumerate(x)]
    return float(min(LEAST_PART * np.median(told), np.quantile(told, LOW_QUANTILE)))


@dataclass(frozen=True)
class LanguageModel:
    families: tuple[tuple[str, ...], ...]
    duels: tuple[tuple[int, int, int], ...]  # family, and two of its languages
    weights: np.ndarray  # a column per family, then one per duel
    profiles: np.ndarray  # a column of log ratios per language
    least: np.ndarray  # evidence that scores LEAST_SCORE, per language

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.families or not has_letter(text):
            return UNKNOWN, 0.0
        x = features(text)
        at, v = x
        margins = v @ self.weights[at]
        sure = lambda m: float(1 / (1 + np.exp(-4 * m)))
        n = len(self.families)
        family = int(margins[:n].argmax())
        score = 1.0 if n == 1 else sure(margins[family])
        languages = self.families[family]
        votes = np.zeros(len(languages))
        mine = [(a, b, float(m)) for (f, a, b), m in zip(self.duels, margins[n:], strict=True) if f == family]
        for a, b, m in mine:
            votes[a if m >= 0 else b] += 1 + 1e-3 * np.tanh(abs(m))
        best = int(votes.argmax())
        won = [m if a == best else -m for a, b, m in mine if best in (a, b)]
        over = float((evidence(x, self.profiles) - self.least).max())
        known = 1 / (1 + (1 / LEAST_SCORE - 1) * np.exp(-4 * over))
        return languages[best], min(score * (sure(min(won)) if won else 1.0), float(known))


NOTHING = LanguageModel((), (), np.zeros((BUCKETS, 0), np.float32), np.zeros((BUCKETS, 0), np.float32), np.zeros(0))


def _rows(at: pa.ListArray, values: pa.ListArray) -> Iterator[Sparse]:
    """The sparse rows of two list columns, as views."""
    ends, flat, data = at.offsets.to_numpy(), at.values.to_numpy(), values.values.to_numpy()
    shift = values.offsets.to_numpy() - ends
    for lo, hi, d in zip(ends[:-1], ends[1:], shift[:-1], strict=True):
        yield flat[lo:hi], data[lo + d : hi + d]


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES) -> LanguageModel:
    """A model from the rows of (doc_id, text, lang); rows without a label or letters, or with a label that is not among
    the ``languages`` most frequent ones, teach nothing."""
    rows = labelled.select(F.col("doc_id").cast("long"), "text", "lang").where("doc_id is not null and lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()}
    if not sizes:
        return NOTHING
    share = F.create_map(*(F.lit(v) for k, n in sizes.items() for v in (k, min(1.0, per_language / n))))
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, at, values, n = [], [], [], []
            for text, lang in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                if has_letter(text.as_py()):
                    c = counts(text.as_py())
                    x = scaled(c)
                    langs.append(lang)
                    n.append(int(c.sum()))
                    at.append(x[0])
                    values.append(x[1])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(at, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32())), pa.array(n, pa.int64())], names=["lang", "at", "v", "n"])

    sample = drawn.select("text", "lang").mapInArrow(sparse, "lang string, at array<int>, v array<float>, n long").toArrow()
    langs, sizes = sample.column("lang").to_pylist(), sample.column("n").to_numpy()
    x = [row for c in zip(sample.column("at").chunks, sample.column("v").chunks, strict=True) for row in _rows(*c)]
    order = sorted(range(len(x)), key=lambda i: (langs[i], x[i][0].tobytes(), x[i][1].tobytes()))  # the same whatever order the rows come in
    x, langs, sizes = [x[i] for i in order], np.array(langs, object)[order], sizes[order]
    by_family: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        by_family.setdefault(family_of(lang), []).append(lang)
    families = tuple(tuple(v) for _, v in sorted(by_family.items()))
    number = {lang: f for f, members in enumerate(families) for lang in members}
    of = np.array([number[lang] for lang in langs])
    machines = [fit_svm(x, np.where(of == f, 1.0, -1.0)) for f in range(len(families))]
    duels = []
    for f, members in enumerate(families):
        for a in range(len(members)):
            for b in range(a + 1, len(members)):
                rows_of = np.flatnonzero(np.isin(langs, [members[a], members[b]]))
                machines.append(fit_svm([x[i] for i in rows_of], np.where(langs[rows_of] == members[a], 1.0, -1.0)))
                duels.append((f, a, b))
    if not machines:
        return NOTHING
    of_language = [([x[i] for i in rows_of], sizes[rows_of]) for rows_of in (np.flatnonzero(langs == lang) for lang in sorted(set(langs)))]
    profiles = np.stack([profile(*o) for o in of_language], axis=1)
    least = np.array([least_evidence(*o) for o in of_language])
    return LanguageModel(families, tuple(duels), np.stack(machines, axis=1), profiles, least)


def predict(docs: DataFrame, model: LanguageModel, *keep: str) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``lang_pred`` and ``score`` of its ``text``."""
    given = docs.select(*keep, F.col("text").alias("_text"))
    schema = given.schema
    out = type(schema)(schema.fields[:-1]).add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = [model.predict(t.as_py()) for t in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([p for p, _ in said], pa.string()), pa.array([s for _, s in said], pa.float64())], names=out.names)

    return given.mapInArrow(run, out)


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def evaluated(docs: DataFrame) -> DataFrame:
    """Predictions for all rows by a model that has not seen the held-out ones."""
    model = train(docs.where(~held_out()))
    return predict(docs.select(F.col("doc_id").cast("long"), "text"), model, "doc_id").select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """``docs`` without the rows whose text is in no language that can be told."""
    model = train(docs.where(~held_out()))
    names = docs.columns
    known = predict(docs.select(*(quoted(c).alias(f"_{i}") for i, c in enumerate(names)), "text"), model, *(f"_{i}" for i in range(len(names))))
    return known.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)).select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(names)))
