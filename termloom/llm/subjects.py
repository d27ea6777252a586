"""Subject areas of documents.

Documents are embedded by term weighting and truncated singular value
decomposition; subjects are seed centroids from labelled documents, refined
iteratively; each sentence of prose goes to the subject with the greatest cosine,
or to none, and a document has the subjects of a sufficient share of its sentences.

The classifier (vocabulary, decomposition, centroids) is fitted on at most
MAX_LABELLED documents: labelled ones and, where they are fewer, others whose
subjects a first fit finds. Document frequencies are counted over all documents,
and all documents and all their sentences are assigned. Texts are read and split
once for the sample and once for all; later passes read written word numbers, and
nothing but those of the sample comes to the driver.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import quality
from .quality import COMMON

MAX_LABELLED = 2000  # documents the classifier is fitted on, labelled ones first
MAX_FIT_WORDS = 8_000_000  # of these documents together
MAX_VOCABULARY = 60_000  # words of the classifier; a number of 16 bits
SENTENCE_END = 65_535
FILL_ROUNDS = 3  # fits that find subjects for documents without labels
MIN_SURE = 3  # sentences about some subject that such a document needs
SURE_SHARE = 0.6  # of them that must be about the subjects found
DIMENSIONS = 40
REFINEMENTS = 6
MIN_SHARE = 0.25  # of the sentences that are about some subject
MAX_GROUPS = 3  # centroids of a subject
MIN_COSINE = 0.4
SMOOTHING = 0.5  # sentences or documents of the overall distribution added to each word's own
MIXED_WEIGHT = 0.1  # of a document of several subjects in the first counts
MIN_INFORMATION = 0.35  # least weight of a word, from 0 (spread evenly over subjects) to 1 (one subject)

SPLIT_SCHEMA = "doc_id bigint, prose boolean, words array<int>"


def sentences(text: str | None) -> tuple[bool, list[list[str]]]:
    """Whether a document is prose, and the words of its sentences of prose."""
    if not text:
        return False, []
    total = prose = 0
    out = []
    for piece, words, _, good in quality.pieces(quality.prepared_body(text)):
        total += len(piece)
        if good:
            prose += len(piece)
            out.append(words)
    return total > 0 and prose >= quality.PROSE_SHARE * total, out


def content_words(words: list[str]) -> list[str]:
    return [w for w in words if len(w) > 2 and w not in COMMON and w.isalpha()]


@dataclass
class Sample:
    """Sentences of the documents the classifier is fitted on, as word numbers, and
    their subjects; a document added to the labelled ones has none yet."""

    vocabulary: dict[str, int]
    docs: list[list[list[int]]]
    subjects: list[set[str]]


def sample_documents(documents: DataFrame, labels: DataFrame, bound: int) -> tuple[DataFrame, dict[int, set[str]]]:
    """(doc_id) of at most ``bound`` documents, and the subjects of those labelled.
    Labelled documents come first, chosen by a hash of their id; where they are
    fewer, others fill the sample up."""
    spark = documents.sparkSession
    ids = documents.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id IS NOT NULL")
    known = labels.where("doc_id IS NOT NULL AND subject IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "subject").distinct().join(ids, "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = {r["doc_id"]: set(r["subjects"]) for r in known.groupBy("doc_id").agg(F.collect_set("subject").alias("subjects")).orderBy(*order).limit(bound).collect()}
    taken = list(chosen)
    if chosen and len(chosen) < bound:
        taken += [r["doc_id"] for r in ids.join(known.select("doc_id"), "doc_id", "left_anti").orderBy(*order).limit(bound - len(chosen)).collect()]
    return spark.createDataFrame([(d,) for d in taken], "doc_id bigint"), chosen


def number_words(documents: DataFrame, labels: DataFrame, bound: int, max_words: int = MAX_VOCABULARY) -> Sample:
    """The sample as word numbers; no text comes to the driver. The vocabulary are the
    words of at least two of its documents, of more than ``max_words`` the most
    frequent. Documents are taken as long as they have MAX_FIT_WORDS words together."""
    spark = documents.sparkSession
    ids, known = sample_documents(documents, labels, bound)
    if not known:
        return Sample({}, [], [])

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [sentences(t) for t in b["text"]]
            flat = [[w for s in sents for w in (*content_words(s), "")] for _, sents in found]
            yield pd.DataFrame({"doc_id": b["doc_id"], "words": flat})[[good for good, _ in found]]

    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
    own = written(texts.mapInPandas(words, "doc_id bigint, words array<string>"), "sample")
    seen = own.select(F.explode(F.array_distinct("words")).alias("word")).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    top = seen.where("n > 1").orderBy(F.desc("n"), "word").limit(max_words).collect()
    vocabulary = {r["word"]: i for i, r in enumerate(top)}
    shared = spark.sparkContext.broadcast(vocabulary)

    def numbers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            packed = [np.array([SENTENCE_END if not w else shared.value[w] for w in words if not w or w in shared.value], dtype="<u2").tobytes() for words in b["words"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "packed": packed})

    packed = written(own.mapInPandas(numbers, "doc_id bigint, packed binary"), "numbers")
    sizes = packed.select("doc_id", (F.octet_length("packed") / 2).cast("bigint").alias("n")).orderBy(~F.col("doc_id").isin(list(known)), F.xxhash64("doc_id"), "doc_id").collect()
    taken, held = [], 0
    for r in sizes:
        if taken and held + r["n"] > MAX_FIT_WORDS:
            break
        taken.append(r["doc_id"])
        held += r["n"]
    rows = packed.where(F.col("doc_id").isin(taken)).collect() if taken else []
    rows.sort(key=lambda r: r["doc_id"])
    docs = []
    for r in rows:
        flat = np.frombuffer(bytes(r["packed"]), dtype="<u2").astype(np.int64)
        docs.append([part[:-1].tolist() for part in np.split(flat, np.flatnonzero(flat == SENTENCE_END) + 1) if len(part)])
    return Sample(vocabulary, docs, [known.get(r["doc_id"], set()) for r in rows])


def with_found_subjects(sample: Sample, subjects: list[str]) -> Sample:
    """The sample with subjects for the documents that have none, as a first fit on
    the others finds them; documents it is not sure of are left out."""
    labelled = [i for i, s in enumerate(sample.subjects) if s]
    rest = [i for i, s in enumerate(sample.subjects) if not s]
    if not rest or not labelled:
        return Sample(sample.vocabulary, [sample.docs[i] for i in labelled], [sample.subjects[i] for i in labelled])
    df = np.zeros(len(sample.vocabulary))
    for sents in sample.docs:
        df[list({w for s in sents for w in s})] += 1
    docs, known = [sample.docs[i] for i in labelled], [sample.subjects[i] for i in labelled]
    flat = np.array([x for i in rest for s in sample.docs[i] for x in (*s, -1)], dtype=np.int64)
    ends = np.flatnonzero(flat == -1)
    starts = np.r_[0, ends[:-1] + 1] if len(ends) else ends
    doc = np.repeat(np.arange(len(rest)), [len(sample.docs[i]) for i in rest])
    for _ in range(FILL_ROUNDS):
        model = fit(Sample(sample.vocabulary, docs, known), df, len(sample.docs), subjects)
        docs, known = [sample.docs[i] for i in labelled], [sample.subjects[i] for i in labelled]
        found = model.sentence_subjects(flat, starts)
        counts = np.zeros((len(rest), len(subjects)), np.int64)
        np.add.at(counts, (doc[found >= 0], found[found >= 0]), 1)
        total = counts.sum(1)
        about = (counts > 0) & (counts >= MIN_SHARE * total[:, None])
        sure = (total >= MIN_SURE) & ((counts * about).sum(1) >= SURE_SHARE * total)
        for k in np.flatnonzero(sure):
            docs.append(sample.docs[rest[k]])
            known.append({subjects[x] for x in np.flatnonzero(about[k])})
    return Sample(sample.vocabulary, docs, known)


def split_documents(documents: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(doc_id, prose, words): the known content words of each sentence of prose
    as numbers, each sentence closed by -1. Narrow; written to the shared folder."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for b in batches:
            prose, words = [], []
            for text in b["text"]:
                good, sents = sentences(text)
                prose.append(good)
                ids: list[int] = []
                if good:
                    for s in sents:
                        ids += [known[w] for w in s if w in known]
                        ids.append(-1)
                words.append(ids)
            yield pd.DataFrame({"doc_id": b["doc_id"], "prose": prose, "words": words})

    source = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return written(source.mapInPandas(run, SPLIT_SCHEMA), "sentences")


def document_frequencies(split: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """Documents of prose that hold each word, over all documents, and their number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(size + 1, dtype=np.int64)
        for b in batches:
            for words in b["words"]:
                ids = np.unique(np.asarray(words, dtype=np.int64))
                counts[ids[ids >= 0]] += 1
            counts[size] += len(b)
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"word": at, "n": counts[at]})

    rows = split.where("prose").select("words").mapInPandas(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(size + 1)
    for r in rows:
        df[r["word"]] = r["n"]
    return df[:size], int(df[size])


def counts_by_document(sample: Sample, index: dict[str, int]) -> np.ndarray:
    """Documents of each subject that hold each word; those of several subjects
    count little, as it is not known which of them a word belongs to."""
    counts = np.zeros((len(sample.vocabulary), len(index)))
    for sents, known in zip(sample.docs, sample.subjects):
        for w in {w for s in sents for w in s}:
            for s in known:
                counts[w, index[s]] += 1.0 if len(known) == 1 else MIXED_WEIGHT
    return counts


def counts_by_sentence(sample: Sample, n_subjects: int, subject: np.ndarray) -> np.ndarray:
    """Sentences of each subject that hold each word; ``subject`` is -1 for none."""
    counts = np.zeros((len(sample.vocabulary), n_subjects))
    found = [(words, s) for words, s in zip((s for sents in sample.docs for s in sents), subject) if s >= 0 and words]
    flat = [list(set(words)) for words, _ in found]
    if flat:
        np.add.at(counts, (np.concatenate(flat), np.repeat([s for _, s in found], [len(w) for w in flat])), 1)
    return counts


def information(counts: np.ndarray) -> np.ndarray:
    """How far each word is concentrated on few subjects: 1 minus the entropy of
    its subjects over the greatest entropy, smoothed by the overall distribution
    so that a rare word is not sure of its subject."""
    prior = counts.sum(0) / max(counts.sum(), 1e-9)
    p = counts + SMOOTHING * prior
    p /= np.maximum(p.sum(1, keepdims=True), 1e-9)
    entropy = -(p * np.log(p + 1e-12)).sum(1)
    info = np.clip(1 - entropy / math.log(max(counts.shape[1], 2)), 0, 1)
    return np.where(counts.sum(1) > 0, info, 0)


def orthonormal(z: np.ndarray) -> np.ndarray:
    """Orthonormal columns of the same span, by the Cholesky factor of their small
    product matrix; by QR where that has not full rank."""
    g = z.astype(np.float64).T @ z.astype(np.float64)
    try:
        return (z @ np.linalg.inv(np.linalg.cholesky(g)).T).astype(np.float32)
    except np.linalg.LinAlgError:
        return np.linalg.qr(z)[0].astype(np.float32)


def truncated_svd(rows: list[dict[int, float]], n_words: int, k: int, rounds: int = 4) -> np.ndarray:
    """Right singular vectors (n_words x k) of the weighted document matrix, by
    randomised subspace iteration with a fixed seed."""
    at = np.concatenate([np.full(len(r), i) for i, r in enumerate(rows)] or [np.zeros(0)]).astype(np.int64)
    word = np.array([w for r in rows for w in r], dtype=np.int64)
    value = np.array([v for r in rows for v in r.values()], dtype=np.float32)[:, None]
    k = max(1, min(k, len(rows), n_words))
    q = orthonormal(np.random.default_rng(7).standard_normal((n_words, k)))
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else at
    by_word = np.argsort(word, kind="stable")
    w_sorted = word[by_word]
    w_starts = np.flatnonzero(np.r_[True, w_sorted[1:] != w_sorted[:-1]]) if len(at) else at
    for _ in range(rounds):
        if not len(at):
            break
        y = np.zeros((len(rows), k), dtype=np.float32)
        y[at[starts]] = np.add.reduceat(value * q[word], starts)
        z = np.zeros((n_words, k), dtype=np.float32)
        z[w_sorted[w_starts]] = np.add.reduceat(value[by_word] * y[at[by_word]], w_starts)
        q = orthonormal(z)
    return q


def unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=-1, keepdims=True)
    return v / np.where(n > 0, n, 1)


@dataclass
class Classifier:
    vocabulary: dict[str, int]
    subjects: list[str]
    words: np.ndarray  # weighted latent vector of each word; zero for words without information
    centroids: np.ndarray  # one or more per subject
    owner: np.ndarray  # subject of each centroid

    def sentence_subjects(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Subject number of each sentence, -1 for none. words: numbers, each
        sentence closed by -1; starts: where each sentence begins."""
        vectors = np.add.reduceat(self.words[words], starts) if len(starts) else np.zeros((0, self.words.shape[1]), np.float32)
        cosine = unit(vectors) @ self.centroids.T
        best = cosine.argmax(1) if len(cosine) else np.zeros(0, np.int64)
        return np.where(cosine[np.arange(len(best)), best] >= MIN_COSINE, self.owner[best], -1)


def fit(sample: Sample, df: np.ndarray, n_docs: int, subjects: list[str]) -> Classifier:
    """Fits twice: word weights first come from the subjects of whole documents,
    then from the subjects of the sentences that the first fit finds."""
    index = {s: i for i, s in enumerate(subjects)}
    first, found = fit_once(sample, counts_by_document(sample, index), df, n_docs, subjects)
    if not len(found):
        return first
    return fit_once(sample, counts_by_sentence(sample, len(subjects), found), df, n_docs, subjects)[0]


def fit_once(sample: Sample, counts: np.ndarray, df: np.ndarray, n_docs: int, subjects: list[str]) -> tuple[Classifier, np.ndarray]:
    """Weights, decomposition, seed centroids and their refinement; also the
    subject of each sentence of the sample."""
    n = len(sample.vocabulary)
    info = information(counts)
    weight = np.where(info >= MIN_INFORMATION, info * np.log((n_docs + 1) / (df + 0.5)).clip(0), 0).astype(np.float32)
    rows = []
    for sents in sample.docs:
        at, tf = np.unique(np.fromiter((w for s in sents for w in s), dtype=np.int64), return_counts=True)
        at, tf = at[weight[at] > 0], tf[weight[at] > 0]
        value = (1 + np.log(tf)) * weight[at]
        rows.append(dict(zip(at.tolist(), (value / max(np.linalg.norm(value), 1e-9)).tolist())))
    basis = truncated_svd(rows, n, DIMENSIONS)
    latent = np.vstack([unit(basis) * weight[:, None], np.zeros((1, basis.shape[1]), np.float32)]).astype(np.float32)

    # seeds: for each subject the groups of its documents that share no words, as the languages do
    seeds: dict[str, list[np.ndarray]] = defaultdict(list)
    for row, known in zip(rows, sample.subjects):
        if len(known) == 1 and row:
            at = np.fromiter(row, dtype=np.int64)
            v = (np.fromiter(row.values(), dtype=np.float32) / np.maximum(weight[at], 1e-9)) @ latent[at]
            seeds[next(iter(known))].append(unit(v))
    centroids, owner = [], []
    for i, s in enumerate(subjects):
        for c in spread_centroids(np.array(seeds[s]) if seeds[s] else np.zeros((0, latent.shape[1])), MAX_GROUPS):
            centroids.append(c)
            owner.append(i)
    model = Classifier(sample.vocabulary, subjects, latent, np.array(centroids or np.zeros((1, latent.shape[1])), dtype=np.float32), np.array(owner or [0]))
    # refinement on the sentences of the sample, held to the documents' own subjects
    index = {s: i for i, s in enumerate(subjects)}
    flat, starts, allowed = [], [], []
    for sents, known in zip(sample.docs, sample.subjects):
        for s in sents:
            starts.append(len(flat))
            flat += [*s, -1]
            allowed.append([index[k] for k in known])
    if not flat or not centroids:
        return model, np.zeros(0, np.int64)
    vectors = unit(np.add.reduceat(latent[np.array(flat)], np.array(starts)))
    member = np.zeros((len(allowed), len(subjects)), bool)
    for r, own in enumerate(allowed):
        member[r, own] = True
    best = sure = None
    for _ in range(REFINEMENTS):
        cosine = vectors @ model.centroids.T
        cosine[~member[:, model.owner]] = -1
        best = cosine.argmax(1)
        sure = cosine[np.arange(len(best)), best] >= MIN_COSINE
        moved = model.centroids.copy()
        for c in range(len(moved)):
            mine = vectors[sure & (best == c)]
            if len(mine):
                moved[c] = unit(mine.mean(0))
        settled = np.allclose(moved, model.centroids, atol=1e-4)
        model.centroids = moved
        if settled:
            break
    return model, np.where(sure, model.owner[best], -1)


def spread_centroids(v: np.ndarray, k: int) -> list[np.ndarray]:
    """At most k centroids: farthest-first seeds, then spherical k-means."""
    if not len(v):
        return []
    chosen = [unit(v.mean(0))] if k == 1 else [v[0]]
    while len(chosen) < min(k, len(v)):
        nearest = (v @ np.array(chosen).T).max(1)
        far = int(nearest.argmin())
        if nearest[far] > 0.3:
            break
        chosen.append(v[far])
    c = np.array(chosen)
    for _ in range(8):
        own = (v @ c.T).argmax(1)
        c = np.array([unit(v[own == j].mean(0)) if (own == j).any() else c[j] for j in range(len(c))])
    return list(c)


def assign(split: DataFrame, model: Classifier, min_share: float = MIN_SHARE) -> DataFrame:
    """(doc_id, subject, sentences, subject_sentences, share) of every subject
    that at least ``min_share`` of a document's subject sentences are about."""
    shared = split.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            docs, texts = b["doc_id"].to_numpy(), b["words"].tolist()
            for lo in range(0, len(docs), 500):
                part = [np.asarray(t, dtype=np.int64) for t in texts[lo : lo + 500]]
                flat = np.concatenate(part) if part else np.zeros(0, np.int64)
                ends = np.flatnonzero(flat == -1)
                starts = np.r_[0, ends[:-1] + 1] if len(ends) else ends
                subject = m.sentence_subjects(flat, starts)
                doc = np.repeat(np.arange(len(part)), [int((p == -1).sum()) for p in part])
                about = subject >= 0
                counts = np.zeros((len(part), len(m.subjects)), np.int64)
                np.add.at(counts, (doc[about], subject[about]), 1)
                total = counts.sum(1)
                d, s = np.nonzero((counts > 0) & (counts >= min_share * total[:, None]))
                yield pd.DataFrame(
                    {
                        "doc_id": docs[lo + d], "subject": pd.Series([m.subjects[x] for x in s], dtype=object), "sentences": counts[d, s],
                        "subject_sentences": total[d], "share": counts[d, s] / np.maximum(total[d], 1),
                    }
                )

    schema = "doc_id bigint, subject string, sentences bigint, subject_sentences bigint, share double"
    return split.where("prose").select("doc_id", "words").mapInPandas(run, schema)


def classified(documents: DataFrame, labels: DataFrame, subjects: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[DataFrame, DataFrame]:
    """The split documents and the subjects assigned to them."""
    names = sorted({r["subject"] for r in subjects.select("subject").where("subject IS NOT NULL").distinct().collect()})
    sample = with_found_subjects(number_words(documents, labels.where(F.col("subject").isin(names)), max_labelled), names)
    split = split_documents(documents, sample.vocabulary)
    df, n = document_frequencies(split, len(sample.vocabulary))
    return split, assign(split, fit(sample, df, n, names))


def document_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Subjects of every document of prose; see ``assign`` for the columns.

    Documents that are not prose, NULL and empty texts have no subject, nor have
    documents without a sentence that is about one. Labels of unknown documents
    or subjects are ignored, repeated ones count once; without labels nothing
    can be fitted and the result is empty."""
    return classified(documents, labels, subjects, max_labelled)[1]


def subject_composition(split: DataFrame, assigned: DataFrame) -> DataFrame:
    """(subject, documents, sentences) over the corpus; the row with a NULL subject
    counts the documents of prose that have none."""
    assigned = written(assigned, "assigned")
    counts = assigned.groupBy("subject").agg(F.count(F.lit(1)).alias("documents"), F.sum("sentences").alias("sentences"))
    without = split.where("prose").join(assigned.select("doc_id").distinct(), "doc_id", "left_anti")
    return counts.unionByName(without.agg(F.lit(None).cast("string").alias("subject"), F.count(F.lit(1)).alias("documents"), F.lit(0).cast("bigint").alias("sentences")))
