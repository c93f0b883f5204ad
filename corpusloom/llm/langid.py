"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

A word's probability in a language is the sum over all its segmentations into vocabulary pieces of the product
of that language's piece probabilities, computed by the forward algorithm. Piece probabilities are fitted by
expectation maximisation on a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusloom.llm.common import read_table, readable
from corpusloom.llm.packing import vocabulary_path

#: Labelled documents per language that the fit may use, at most; its rounds; numbers of a lattice that are held at once.
SAMPLE_DOCS, ROUNDS, HELD = 400, 2, 2_000_000
#: Pseudo-count of a piece, and the most that an earlier prefix may outweigh a later one (no piece spans more).
PRIOR, MOST = 0.05, 1e300
MARK, CODE = "▁", np.uint64(0x9E3779B97F4A7C15)
LEAST_SCORE = 0.3

_vocabularies: dict = {}


class Vocabulary:
    """Pieces of the 32k vocabulary that consist of lower-case letters, with or without the word mark, and its 256 byte pieces.

    Every letter can be read as its bytes, so each language learns what letters outside the other pieces cost.
    """

    def __init__(self, folder: str | None):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model", folder))
        plain = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
        kept = sorted({p for p in plain if (body := p.removeprefix(MARK)).isalpha() and body == body.lower() or p == MARK})
        self.bytes_from, self.size, self.longest = len(kept), len(kept) + 256, max(map(len, kept))
        self.tables = []
        for k in range(1, self.longest + 1):
            own = [i for i, p in enumerate(kept) if len(p) == k]
            codes = self._codes([kept[i] for i in own], k)
            order = np.argsort(codes)
            self.tables.append((codes[order], np.array(own, np.int32)[order]))

    @staticmethod
    def _letters(words: list[str], n: int) -> np.ndarray:
        return np.array(words, f"<U{n}").view("<u4").reshape(len(words), n).astype(np.uint64)

    def _codes(self, words: list[str], n: int) -> np.ndarray:
        code = np.zeros(len(words), np.uint64)
        for letter in self._letters(words, n).T if words else ():
            code = code * CODE + letter
        return code

    def byte_pieces(self, letters: np.ndarray) -> np.ndarray:
        """[letter, 4]: the ids of the byte pieces of each code point (-1: none)."""
        out = np.full((len(letters), 4), -1, np.int64)
        for row, letter in enumerate(letters.tolist()):
            raw = chr(letter).encode("utf-8", "surrogatepass")
            out[row, : len(raw)] = np.frombuffer(raw, np.uint8).astype(np.int64) + self.bytes_from
        return out

    def lattice(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Words of equal length together: their places, the id of each piece by word, start and length (-1: none), their letters."""
        by_length: dict[int, list[int]] = {}
        for place, word in enumerate(words):
            by_length.setdefault(len(word) + 1, []).append(place)
        for n, group in by_length.items():
            together = max(1, min(2048, HELD // (n * min(self.longest, n))))
            for at in range(0, len(group), together):
                places = group[at : at + together]
                letters = self._letters([MARK + words[i] for i in places], n)
                ids = np.full((len(places), n, min(self.longest, n)), -1, np.int32)
                code = np.zeros_like(letters)
                for k, (codes, pieces) in enumerate(self.tables[:n]):
                    code = code[:, : n - k] * CODE + letters[:, k:]
                    if len(codes):
                        found = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                        ids[:, : n - k, k] = np.where(codes[found] == code, pieces[found], -1)
                yield np.array(places), ids, letters


def vocabulary(folder: str | None) -> Vocabulary:
    if folder not in _vocabularies:
        _vocabularies[folder] = Vocabulary(folder)
    return _vocabularies[folder]


def _spelled(letters: np.ndarray, p: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The mass [word, start, language] of each letter as a run of byte pieces, its distinct letters' pieces, and which letter stands where."""
    distinct, which = np.unique(letters, return_inverse=True)
    pieces, which = v.byte_pieces(distinct), which.reshape(letters.shape)
    return np.where(pieces[:, :, None] >= 0, p[pieces], 1.0).prod(1)[which], pieces, which


def _prefixes(ids: np.ndarray, spelled: np.ndarray, p: np.ndarray, back: bool = False) -> np.ndarray:
    """Logarithms [word, language, end]: the mass of all segmentations of each prefix, or with ``back`` of each suffix; ``p`` is [piece, language].

    Masses are held as multiples of the last one, which no word is too long or too strange for.
    """
    words, n, longest = ids.shape
    logs, near = np.zeros((words, p.shape[1], n + 1)), np.zeros((words, p.shape[1], longest + n + 1))
    near[:, :, longest] = 1  # the empty prefix; before it there is none
    length = np.arange(1, longest + 1)
    step = max(1, HELD // max(1, words * longest * p.shape[1]))
    for low in range(1, n + 1, step):
        # the pieces that end in a slice of ends, by length; masses are carried from slice to slice
        ends = np.arange(low, min(n + 1, low + step))
        starts = np.where(length <= ends[:, None], n - ends[:, None] if back else ends[:, None] - length, -1)
        mass_of = p[np.where(starts >= 0, ids[:, np.maximum(starts, 0), length - 1], -1)]
        for row, end in enumerate(ends.tolist()):
            window = near[:, :, end : end + longest]
            mass = spelled[:, n - end if back else end - 1] + np.einsum("wlk,wkl->wl", window[:, :, ::-1], mass_of[:, row])
            logs[:, :, end] = logs[:, :, end - 1] + np.log(mass)
            with np.errstate(over="ignore"):
                np.minimum(window / mass[:, :, None], MOST, out=window)
            near[:, :, longest + end] = 1
    return logs[:, :, ::-1] if back else logs


def word_scores(words: list[str], p: np.ndarray, folder: str | None = None) -> np.ndarray:
    """Log-probabilities [word, language]; ``p`` has a last row of zeros for absent pieces."""
    out, v = np.zeros((len(words), p.shape[1])), vocabulary(folder)
    for places, ids, letters in v.lattice(words):
        out[places] = _prefixes(ids, _spelled(letters, p, v)[0], p)[:, :, -1]
    return out


def fit(words: list[str], counts: np.ndarray, folder: str | None = None, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of one language, from its words and their counts."""
    v = vocabulary(folder)
    p = np.full((v.size + 1, 1), 1.0 / v.size)
    p[-1] = 0
    lattices = list(v.lattice(words))
    for _ in range(rounds):
        expected = np.full(v.size + 1, PRIOR)
        for places, ids, letters in lattices:
            n, longest = ids.shape[1:]
            spelled, pieces, which = _spelled(letters, p, v)
            before, after = _prefixes(ids, spelled, p)[:, 0], _prefixes(ids, spelled, p, back=True)[:, 0]
            weights = counts[places]
            length = np.arange(1, longest + 1)
            step = max(1, HELD // (len(places) * longest))
            for low in range(0, n, step):
                starts = np.arange(low, min(n, low + step))
                begun = before[:, starts] - before[:, [n]]
                alone = np.exp(begun + after[:, starts + 1]) * spelled[:, starts, 0]
                by_letter = np.bincount(which[:, starts].ravel(), weights=(weights[:, None] * alone).ravel(), minlength=len(pieces))
                np.add.at(expected, pieces, np.where(pieces >= 0, by_letter[:, None], 0.0))
                found = ids[:, starts]
                between = np.where(found >= 0, begun[:, :, None] + after[:, np.minimum(starts[:, None] + length, n)], 0.0)
                share = np.exp(between) * p[found, 0]
                expected += np.bincount((found % (v.size + 1)).ravel(), weights=(weights[:, None, None] * share).ravel(), minlength=v.size + 1)
        expected[-1] = 0
        p = (expected / expected.sum())[:, None]
    return p[:, 0]


def split_words(texts: pa.Array) -> pa.ListArray:
    """Lower-case runs of letters, whole, however long."""
    plain = pc.utf8_lower(pc.fill_null(texts, ""))
    spaced = pc.replace_substring_regex(plain, r"[^\pL]+", " ")
    return pc.split_pattern(pc.utf8_trim(spaced, " "), " ")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, folder: str | None = None) -> tuple[list[str], np.ndarray]:
    """Languages and their piece probabilities [piece, language], from rows whose ``doc_id`` isn't held out.

    At most ``sample_docs`` documents a language are used, those first in the order of a hash of ``doc_id``:
    the only bounded sample of this operator.
    """
    labelled = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    keyed = labelled.withColumn("draw", F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    # thinned by a threshold per language first, so that no window holds a language's rows
    totals = keyed.groupBy(F.col("lang").alias("language")).count()
    thin = keyed.join(F.broadcast(totals) if totals.count() <= 1000 else totals, F.col("lang") == F.col("language")).where(F.col("draw") * F.col("count") <= 2 * sample_docs)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id", F.xxhash64("text")))
    sample = thin.withColumn("rank", rank).where(F.col("rank") <= sample_docs).select("lang", "text")
    rows = sample.withColumn("text", F.col("text").cast("binary")).toArrow()
    langs = sorted(set(rows["lang"].to_pylist()))
    p = np.zeros((vocabulary(folder).size + 1, len(langs)))
    for k, lang in enumerate(langs):
        words = pc.value_counts(split_words(readable(rows.filter(pc.equal(rows["lang"], lang))["text"].combine_chunks())).flatten())
        pairs = [(w, n) for w, n in zip(words.field(0).to_pylist(), words.field(1).to_pylist(), strict=True) if w]
        p[:, k] = fit([w for w, _ in pairs], np.array([n for _, n in pairs], float), folder)
    return langs, p


def predict(docs: DataFrame, langs: list[str], p: np.ndarray, folder: str | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds the two columns of ``names`` to every row; the model is languages times 23k numbers, whatever the data."""
    own = docs.drop(*names)
    text_at = own.columns.index("text")
    schema = T.StructType([*own.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    model = docs.sparkSession.sparkContext.broadcast((langs, p))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, p = model.value
        cache: dict[str, int] = {"": 0}
        known = np.zeros((1, len(langs)))
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                split = split_words(readable(batch.column(text_at)))
                coded = split.flatten().dictionary_encode()
                unique = coded.dictionary.to_pylist()
                if len(cache) > 200_000:
                    cache, known = {"": 0}, np.zeros((1, len(langs)))
                if fresh := [w for w in unique if w not in cache]:
                    cache.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
                    known = np.vstack([known, word_scores(fresh, p, folder)])
                rows = np.array([cache[w] for w in unique], np.int64)[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
                ends = split.offsets.to_numpy() - split.offsets[0].as_py()
                filled, total = ends[1:] > ends[:-1], np.zeros((batch.num_rows, len(langs)))
                if len(langs) and filled.any():
                    total[filled] = np.add.reduceat(known[rows], ends[:-1][filled], axis=0)
                letters = np.r_[0, np.cumsum(rows > 0)]
                blank = (letters[ends[1:]] == letters[ends[:-1]]) | (len(langs) == 0)
                if len(langs):
                    best = total.argmax(axis=1)
                    score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                    told = np.array(langs, object)[best]
                else:
                    score, told = np.zeros(batch.num_rows), np.full(batch.num_rows, "und", object)
                told[blank], score[blank] = "und", 0.0
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(told, pa.string()), pa.array(score)], names=schema.names)

    return own.mapInArrow(score, schema)


def identify(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, folder: str | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds ``lang_pred, score`` (or ``names``) to every row of ``docs``; the score is the posterior under equal priors.

    A text that is null or without letters gets ``und`` and score 0, as does every text if no labelled row
    can be learned from; ties go to the language first by name; a row's result depends on its text and the model
    alone, so repeated rows get equal ones; an empty table gives none. Columns of these two names in ``docs`` are
    replaced, others are kept.
    """
    langs, p = train(docs, sample_docs, folder)
    return predict(docs, langs, p, folder, names)


def keep_identified(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language is told with at least ``least_score``; those without letters or text go.

    All columns come back as they were, whatever their names; repeated rows stay or go together; an empty table
    gives no row.
    """
    told, score = "_lang_told", "_lang_score"
    found = identify(docs, names=(told, score))
    return found.where((F.col(told) != "und") & (F.col(score) >= least_score)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return identify(docs.select("doc_id", "text", "lang")).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
