"""Language identification: known words first, then ever shorter character n-grams."""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerokpi.llm.units import bare_units, chunks

#: Labelled documents that a model is fitted on (a hashed sample of about this many beyond it,
#: drawn per language).
MAX_TRAINING_DOCS = 20_000
LONGEST_GRAM = 4
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Distinct units scored per worker before the memory is emptied.
MEMORY = 400_000
UNDETERMINED = "und"


def words_of(text: str) -> list[str]:
    return [w.casefold() for w in LETTERS.findall(text)]


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams of a word with its ends marked (a single character has no mark)."""
    marked = word if n == 1 else f" {word} "
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class WordFirstModel:
    """Log frequencies per language of words and of n-grams of each length."""

    def __init__(self, languages: list[str], tables: list[tuple[dict[str, int], np.ndarray]]):
        """tables[0]: words; tables[n]: n-grams; each as places of the items and rows of scores."""
        self.languages, self.tables = languages, tables

    @staticmethod
    def from_counts(rows: Iterable[tuple[int, str, str, int]]) -> "WordFirstModel":
        """rows: (0 for words or n, item, language, count)."""
        places: list[dict[str, int]] = [{} for _ in range(LONGEST_GRAM + 1)]
        cells = [(array("q"), array("q"), array("d")) for _ in places]
        at: dict[str, int] = {}
        for n, item, language, count in rows:
            place = places[n].setdefault(item, len(places[n]))
            for column, x in zip(cells[n], (place, at.setdefault(language, len(at)), count)):
                column.append(x)
        languages = sorted(at)
        order = np.array([at[x] for x in languages], dtype=np.int64)
        tables = []
        for found, (place, of, count) in zip(places, cells):
            counts = np.zeros((len(found), len(languages)))
            np.add.at(counts, (np.frombuffer(place, np.int64), np.frombuffer(of, np.int64)), np.frombuffer(count))
            counts = counts[:, order]
            tables.append((found, np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * (len(found) + 1)))))
        return WordFirstModel(languages, tables)

    def word_scores(self, word: str) -> np.ndarray | None:
        """Log frequency of a known word; else the mean over its known n-grams of the largest
        n that has any; None for a word of unknown characters only."""
        places, scores = self.tables[0]
        known = places.get(word)
        if known is not None:
            return scores[known]
        for n in range(LONGEST_GRAM, 0, -1):
            places, scores = self.tables[n]
            found = [places[g] for g in grams_of(word, n) if g in places]
            if found:
                return scores[found].sum(axis=0) / len(found)
        return None


class ScoredUnits:
    """Summed word scores and numbers of words of distinct units."""

    def __init__(self, model: WordFirstModel):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.codes: dict[bytes, int] = {}
        self.scores = np.zeros((0, len(self.model.languages)))
        self.letters = np.zeros(0, dtype=bool)

    def of(self, units: list[bytes]) -> np.ndarray:
        if len(self.codes) + len(units) > MEMORY:
            self.clear()
        new = [u for u in units if u not in self.codes]
        scores, letters = np.zeros((len(new), len(self.model.languages))), np.zeros(len(new), dtype=bool)
        for i, unit in enumerate(new):
            self.codes[unit] = len(self.letters) + i
            for word in words_of(unit.decode()):
                letters[i] = True
                if (s := self.model.word_scores(word)) is not None:
                    scores[i] += s
        self.scores, self.letters = np.concatenate((self.scores, scores)), np.concatenate((self.letters, letters))
        return np.fromiter((self.codes[u] for u in units), dtype=np.int64, count=len(units))


def counted(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(kind, item, lang, n): how often words (kind 0) and n-grams (kind n) occur in each language."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for a, b, data, offsets in chunks(rows.column(1)):
                units, unit_rows = bare_units(data, offsets)
                langs = rows.column(0).slice(a, b - a).dictionary_encode()
                coded = units.dictionary_encode()
                pair = coded.indices.to_numpy().astype(np.int64) * len(langs.dictionary) + langs.indices.to_numpy()[unit_rows]
                found, n = np.unique(pair, return_counts=True)
                names, texts = langs.dictionary.to_pylist(), coded.dictionary.to_pylist()
                counts: Counter[tuple[int, str, str]] = Counter()
                for p, c in zip(found.tolist(), n.tolist()):
                    unit, lang = divmod(p, len(names))
                    for word in words_of(texts[unit].decode()):
                        counts[0, word, names[lang]] += c
                for (_, word, lang), c in list(counts.items()):
                    for k in range(1, LONGEST_GRAM + 1):
                        for gram in grams_of(word, k):
                            counts[k, gram, lang] += c
                kinds, items, of, ns = zip(*((k, w, x, c) for (k, w, x), c in counts.items())) if counts else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kinds, pa.int32()), pa.array(items, pa.string()), pa.array(of, pa.string()), pa.array(ns, pa.int64())],
                    names=["kind", "item", "lang", "n"])

    return docs.select(lang_col, text_col).mapInArrow(work, "kind int, item string, lang string, n long") \
        .groupBy("kind", "item", "lang").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, lang_col: str, text_col: str, key: Column, max_docs: int = MAX_TRAINING_DOCS) -> WordFirstModel:
    """A model of the labelled documents: all, or a sample of about `max_docs` by the hash of
    `key`, which takes equally many of each language as far as there are and at least one.
    The model knows every word and n-gram of the learned documents; the driver gathers
    their vocabulary, which only the sample bounds."""
    labelled = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(key), F.lit(1 << 30)).alias("place")) \
        .where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    place = F.col("place")
    sizes = {r[0]: (r.n, r.least) for r in labelled.groupBy("lang").agg(F.count("*").alias("n"), F.min(place).alias("least")).collect()}
    if sum(n for n, _ in sizes.values()) > max_docs:
        quota = quotas({x: n for x, (n, _) in sizes.items()}, max_docs)
        last = [(x, max(int((1 << 30) * quota[x] / n) - 1, least)) for x, (n, least) in sizes.items()]
        table = docs.sparkSession.createDataFrame(last, "learned_lang string, last_place long")
        labelled = labelled.join(F.broadcast(table), F.col("lang").cast("string") == F.col("learned_lang")).where(place <= F.col("last_place"))
    rows = counted(labelled, "lang", "text").toLocalIterator()
    return WordFirstModel.from_counts(rows)


def quotas(sizes: dict[str, int], total: int) -> dict[str, float]:
    """Shares of `total` that are equal but for languages with fewer documents, which give all."""
    out: dict[str, float] = {}
    for i, (x, n) in enumerate(sorted(sizes.items(), key=lambda s: (s[1], s[0]))):
        out[x] = min(n, (total - sum(out.values())) / (len(sizes) - i))
    return out


def predict(docs: DataFrame, model: WordFirstModel, keep: list[str], text_col: str) -> DataFrame:
    """The columns `keep` with lang_pred and score (the posterior of that language, all
    languages being equally likely before). A text that is null or has no letter, and any
    text if the model knows no language, is `und` with score 0. Ties go to the first
    language in order."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.tables))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        memory = ScoredUnits(WordFirstModel(*shared.value))
        names = memory.model.languages
        for rows in batches:
            for a, b, data, offsets in chunks(rows.column(len(keep))):
                units, unit_rows = bare_units(data, offsets)
                coded = units.dictionary_encode()
                code = memory.of(coded.dictionary.to_pylist())[coded.indices.to_numpy()] if len(units) else np.empty(0, dtype=np.int64)
                total = np.column_stack([np.bincount(unit_rows, memory.scores[code, j], b - a) for j in range(len(names))]) \
                    if names else np.zeros((b - a, 1))
                letters = np.bincount(unit_rows, memory.letters[code], b - a) > 0
                best = total.argmax(axis=1)
                score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                known = letters & bool(names)
                columns = [rows.column(i).slice(a, b - a) for i in range(len(keep))]
                columns += [pa.array([names[i] if ok else UNDETERMINED for i, ok in zip(best, known)], pa.string()),
                            pa.array(np.where(known, score, 0.0))]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return docs.select(*keep, text_col).mapInArrow(work, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             max_docs: int = MAX_TRAINING_DOCS) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score.

    Documents whose crc32(id as text) mod 4 is 2 are held out; the model is fitted on the
    others that have a language. Only the text enters a prediction. A null id is neither
    held out nor learned from; a null or letterless text is `und`; repeated rows are scored
    alike; an empty table gives an empty result; other columns are ignored.
    """
    remainder = F.crc32(F.col(id_col).cast("string").cast("binary")) % 4
    model = fit(docs.where(remainder != 2), lang_col, text_col, F.col(id_col), max_docs)
    marked = docs.select(F.col(id_col), F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), F.col(text_col).alias("_text"))
    return predict(marked, model, [id_col, "held_out"], "_text")
