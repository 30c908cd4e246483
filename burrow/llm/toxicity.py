"""Toxicity by a weighted lexicon (operator 4).

Texts are folded first: look-alike letters become Latin ones, and digits and signs inside words the letters they
stand for. One Aho-Corasick pass then finds lexicon entries, anchored at word starts, and exception phrases; an
entry inside an exception doesn't count. The weights found are set against the length of the text.

Entries and weights are learnt: candidates are whole folded words and their first letters, weighed by how much
more often toxic documents hold them. A logistic curve over the weights found turns them into a score. Both are
fitted on a bounded sample of labelled rows, one half each; scoring covers every row.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from burrow.llm.store import written

#: Letters that look like Latin ones, each with its letter, and digits and signs that stand for letters.
LOOK_ALIKES = dict(
    "аa вb еe ёe іi їi кk мm нh оo рp сc тt уy хx ѕs јj ԁd ԛq ԝw һh գq հh ոn օo սu αa βb γy εe ηn ιi κk νv οo ρp τt υu χx ωw ıi ɡg łl".split()
)
DIGITS = dict(zip("013457", "oieast", strict=True))
SIGNS = dict(zip("@$!|", "asii", strict=True))
FOLD = str.maketrans(LOOK_ALIKES)
LOOKS = re.compile(f"[{''.join(LOOK_ALIKES)}]")
STANDS = re.compile(r"[013457@$!|]")
#: Digits and signs between letters; digits at a word's start only if the word has such ones further in (1d10t, not 5th).
SPELT = re.compile(r"(?<=[^\W\d_])(?:[013457]+|[@$!|]+)(?=[^\W\d_])|\b[013457]+(?=[^\W\d_]+[013457@$!|]+[^\W\d_])")
BREAK = re.compile(r"[\W_]+")
#: Phrases in which a lexicon word does no harm.
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "loser bracket", "stupid simple", "pond scum")


def fold(text: str | None) -> str:
    """Lower case, look-alikes and inner digits replaced, words set apart by one space, a space at both ends."""
    text = (text or "").lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        if LOOKS.search(text):
            text = text.translate(FOLD)
    if STANDS.search(text):
        text = SPELT.sub(lambda m: "".join(DIGITS.get(c) or SIGNS.get(c) or c for c in m[0]), text)
    return f" {BREAK.sub(' ', text).strip()} "


@dataclass(frozen=True)
class Model:
    """entries: folded word starts (whole words end in a space) and weights. curve: of the logistic score."""

    entries: dict[str, float]
    curve: tuple[float, ...]
    exceptions: tuple[str, ...] = EXCEPTIONS


def automaton(entries: dict[str, float], exceptions: Iterable[str] = ()):
    import ahocorasick

    found = ahocorasick.Automaton()
    for entry, weight in entries.items():
        found.add_word(f" {entry}", (len(entry) + 1, weight))
    for phrase in exceptions:
        found.add_word(folded := fold(phrase), (len(folded), None))
    found.make_automaton()
    return found


def features(folded: str, matcher) -> tuple[float, float, float]:
    """(weight found, words found, words) of a folded text. A word counts once, by its best entry."""
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    if len(matcher):
        for end, (length, weight) in matcher.iter(folded):
            start = end - length + 1
            if weight is None:
                spared.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
    if spared:
        best = {at: w for at, w in best.items() if not any(a <= at < b for a, b in spared)}
    return sum(best.values()), float(len(best)), float(max(1, folded.count(" ") - 1))


def _inputs(found: np.ndarray) -> np.ndarray:
    """Weight found, as it is and normalised by length; a constant."""
    weight, hits, words = found.reshape(-1, 3).T
    per_length = 100 * weight / (words + 50)
    return np.stack([np.ones_like(weight), np.log1p(weight), np.log1p(per_length), np.minimum(hits, 5.0), np.log1p(words)], axis=1)


def scores(found: np.ndarray, curve: tuple[float, ...]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_inputs(found) @ np.asarray(curve), -30, 30)))


def fit_curve(found: np.ndarray, label: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> tuple[float, ...]:
    """Ridge logistic regression by Newton's method."""
    x, w = _inputs(found), np.zeros(5)
    if not len(x) or label.min(initial=1) == label.max(initial=0):
        return (-3.0, 0.0, 2.0, 0.0, 0.0)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(5), x.T @ (label - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample: int = 24_000,
    lengths: tuple[int, ...] = (3, 4, 5, 6, 7, 8),
    support: int = 3,
    least_weight: float = 2.0,
    most_entries: int = 20_000,
    exceptions: tuple[str, ...] = EXCEPTIONS,
) -> Model:
    """A lexicon and a score curve from labelled documents.

    At most `sample` labelled rows are read, those with the smallest hashes of their ids: half of them for the
    entries, half for the curve. Rows with a null id or label are left out, an id labelled twice is toxic if one of
    its labels is. An entry needs `support` toxic documents and `least_weight` in log odds; all are weighed, and the
    `most_entries` heaviest are kept, which bounds what goes through the driver and to the tasks. Without labelled rows the lexicon is empty and every score is low.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    turn = F.xxhash64("id", F.lit("toxicity sample"))
    chosen = known.orderBy(turn, "id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(F.broadcast(chosen), "id").select("label", "text", (F.pmod(turn, F.lit(2)) == 0).alias("first"))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[Counter] = [Counter(), Counter()]
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = set(fold(text).split())
                starts = {w[:n] for w in words for n in lengths if len(w) >= n}
                counts[label > 0].update([*(f"{w} " for w in words), *starts])
                counts[label > 0][""] += 1
        keys = list(counts[1] | counts[0])
        for at in range(0, len(keys), 50_000):
            part = keys[at : at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), *(pa.array([c[k] for k in part], pa.int64()) for c in counts)], ["term", "clean", "toxic"]
            )

    split = rows.where("first").select("label", "text").mapInArrow(terms, "term string, clean long, toxic long")
    totals = written(split.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "terms")
    n_clean, n_toxic = next(iter(totals.where("term = ''").select("clean", "toxic").collect()), (0, 0))
    # A half count more on either side keeps rare entries from outweighing common ones.
    weight = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    heavy = totals.where(F.col("term") != "").where(F.col("toxic") >= support).withColumn("weight", weight).where(F.col("weight") >= least_weight)
    entries = {r.term: r.weight for r in heavy.orderBy(F.desc("weight"), "term").limit(most_entries).collect()}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = automaton(entries, exceptions)
        for batch in batches:
            found = np.array([features(fold(t), matcher) for t in batch.column(1).to_pylist()]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found.T.copy())], ["label", "a", "b", "c"])

    second = rows.where("NOT first").select("label", "text").mapInArrow(measure, "label int, a double, b double, c double").collect()
    table = np.array([tuple(r) for r in second], float).reshape(-1, 4)
    return Model(entries, fit_curve(table[:, 1:], (table[:, 0] > 0).astype(float)), exceptions)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with the column `score_col` (0 to 1; it replaces one of that name).

    The score depends on the text alone. Null and empty texts hold no entry and get the score of a clean text. All
    rows and columns stay, whatever their values; an empty table stays empty.
    """

    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = automaton(model.entries, model.exceptions)
        for part in texts:
            found = np.array([features(fold(t), matcher) for t in part]).reshape(-1, 3)
            yield pd.Series(scores(found, model.curve))

    return docs.withColumn(score_col, of(F.col(text_col).cast("string")))
