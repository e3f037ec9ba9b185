"""Quality rules: plain counts, and how well a public tokeniser's vocabulary fits a text.

For every text the number of characters per token, the share of byte-fallback tokens and the entropy of its tokens
are measured with public vocabularies and averaged over them. Bands of these per language (or script) and length decide; they come from
quantiles over all texts of the language and class of lengths, widened by a multiple of the distance between the quartiles.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import read_ranks
from .common import sliced, small, stored
from .packing import parted

_CACHE = 200_000
_SYMBOLS, _BLANKS = "#*$%&|<>", " \t\n\r\x0b\x0c"
MEASURES = ("chars_per_token", "fallback_share", "token_entropy")
#: Half-widths of the bands, in distances between the quartiles; the number of tokens at which bands of a whole language
#: are twice as wide as for very long texts, as short texts vary more; and the least half-width of each measure.
SPREAD, SHORT, LEAST = 3.0, 100, (0.05, 0.02, 0.5)
#: Classes of lengths are powers of two in tokens; those below 2 ** SHORTEST are one class. A class with fewer than
#: LEAST_TEXTS texts has no quartiles of its own; its texts are judged by those of the language.
SHORTEST, LEAST_TEXTS = 6, 40
_SCHEMA = """doc_id long, band string, n_words long, word_chars long, n_symbols long, n_dup_lines long,
 n_repeat_words long, n_tokens long, chars_per_token double, fallback_share double, token_entropy double"""


class _Pieces(dict):
    """A SentencePiece vocabulary: ids of single words as bytes, emptied when they are too many."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.fallback = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])

    def meet(self, texts: list[list[bytes]]) -> None:
        """Encode the words of some texts that aren't known, all at once."""
        words = set().union(*texts)
        if len(self) + len(words) > _CACHE:
            self.clear()
        new = list(words - self.keys())
        ids = self.model.encode([w.decode("utf-8", "surrogatepass") for w in new], num_threads=1)
        self.update(zip(new, (array("i", x).tobytes() for x in ids), strict=True))

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, words)), np.int32)


class _Bytes:
    """A byte-level vocabulary of ranks; it falls back where a lone byte of a longer character is a token."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        ranks = read_ranks(path)
        self.model = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.fallback = np.zeros(max(ranks.values()) + 1, bool)
        self.fallback[[i for t, i in ranks.items() if len(t) == 1 and t[0] >= 128]] = True

    def meet(self, texts: list[list[bytes]]) -> None:
        pass

    def ids(self, words: list[bytes]) -> np.ndarray:
        text = b" ".join(words).decode("utf-8", "surrogatepass")
        return np.concatenate([np.empty(0, np.uint32), *map(self.model.encode_to_numpy, parted(text))])


def measures(ids: np.ndarray, fallback: np.ndarray, chars: int) -> tuple[float, float, float]:
    """Characters per token, share of fallback tokens and entropy in bits of a text's tokens, of which there is one at least."""
    p = np.unique(ids, return_counts=True)[1] / len(ids)
    return chars / len(ids), float(fallback[ids].mean()), float(-(p * np.log2(p)).sum())


def _numbered(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the distinct pairs (a, b), b below n, and how often each comes."""
    _, at, count = np.unique(a * np.int64(n) + b, return_inverse=True, return_counts=True)
    return at, count


def repeated_words(words: list, width: int = 5) -> int:
    """Words in windows of ``width`` words that are found twice or more, the first place included."""
    if len(words) <= width:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    code = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    at, n, size = code, len(number), 1
    while size < width:
        # runs of equal length are joined as long as they fit, then words are added one by one
        more, base, step = (at, n, size) if 2 * size <= width else (code, len(number), 1)
        size += step
        at, count = _numbered(at[: len(words) - size + 1], more[size - step :][: len(words) - size + 1], base)
        if len(count) == len(at):
            return 0
        n = len(count)
    cover = np.zeros(len(words) + 1, np.int64)
    again = np.flatnonzero(count[at] > 1)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + width, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def _measured(paths: tuple[str, ...], pattern: str):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies = [_Bytes(p, pattern) if p.endswith(".tiktoken") else _Pieces(p) for p in paths]
        for batch in sliced(it):
            rows = []
            texts = [text or "" for text in batch.column("text").to_pylist()]
            split = [text.encode("utf-8", "surrogatepass").split() for text in texts]
            for v in vocabularies:
                v.meet(split)
            for text, words in zip(texts, split, strict=True):
                seen: set = set()
                again = 0
                for line in text.split("\n"):
                    if line.encode("utf-8", "surrogatepass").split():
                        again += line in seen
                        seen.add(line)
                chars, found = len(text) - sum(map(text.count, _BLANKS)), [v.ids(words) for v in vocabularies]
                n = len(found[0])
                own = [measures(ids, v.fallback, chars) for ids, v in zip(found, vocabularies, strict=True) if len(ids)]
                means = tuple(sum(x) / len(x) for x in zip(*own, strict=True)) if n else (None,) * 3
                symbols = sum(map(text.count, _SYMBOLS))
                rows.append((len(words), chars, symbols, again, repeated_words(words), n, *means))
            columns = list(zip(*rows, strict=True)) or [()] * 9
            kinds = [pa.int64()] * 6 + [pa.float64()] * 3
            data = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.record_batch([batch.column("doc_id"), batch.column("band"), *data], _SCHEMA_NAMES)

    return batches


_SCHEMA_NAMES = [c.split()[0] for c in _SCHEMA.split(",")]


def measure(docs: DataFrame, vocabularies: Sequence[str], pattern: str, band: str = "lang") -> DataFrame:
    """Counts and tokeniser measures of every row of ``docs``.

    ``vocabularies`` are paths of SentencePiece models or of .tiktoken files, whose split into words is ``pattern``.
    Measures are means over the vocabularies; n_tokens is of the first.
    """
    rows = docs.select("doc_id", F.coalesce(F.col(band).cast("string"), F.lit("")).alias("band"), "text")
    return rows.mapInArrow(_measured(tuple(vocabularies), pattern), _SCHEMA)


def quality(docs: DataFrame, vocabularies: Sequence[str], pattern: str, band: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, counts, base_failed, kept, and the measures that kept comes from.

    Words are runs of anything but ASCII white space, lines are compared whole. base_failed: fewer than 10 words, or
    over 20 % of the words in repeated 5-word windows. kept is false for these, and for texts of any length with a
    measure outside the band of their language and class of lengths; the lower side of the fallback share has no bound.
    A null text counts as empty and fails; a null language is a group of its own. Rows that repeat are judged each.
    Other columns are ignored; an empty table gives no rows.
    """
    rows = stored(measure(docs, vocabularies, pattern, band), "measures")
    length = F.greatest(F.floor(F.log2("n_tokens")), F.lit(SHORTEST - 1)).cast("int")
    rows = rows.withColumn("length", F.when(F.col("n_tokens") > 0, length))
    quartiles = lambda to: [F.percentile_approx(m, [0.25, 0.5, 0.75], 10000).alias(f"{to}_{m}") for m in MEASURES]
    judged = rows.where("n_tokens > 0")
    classes = judged.groupBy("band", "length").agg(F.count("*").alias("n"), *quartiles("q")).where(f"n >= {LEAST_TEXTS}")
    classes = stored(classes.drop("n"), "classes")
    languages = stored(judged.groupBy("band").agg(*quartiles("all")), "languages")
    out = rows.join(small(classes), ["band", "length"], "left").join(small(languages), "band", "left")
    inside = F.lit(True)
    for m, least in zip(MEASURES, LEAST, strict=True):
        own, q = F.col(f"q_{m}").isNotNull(), F.coalesce(f"q_{m}", f"all_{m}")
        width = F.greatest(SPREAD * (q[2] - q[0]), F.lit(least)) * F.when(own, 1.0).otherwise(1 + SHORT / F.greatest("n_tokens", F.lit(1)))
        low = F.lit(True) if m == "fallback_share" else F.col(m) >= q[1] - width
        inside = inside & low & (F.col(m) <= q[1] + width)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    fits = F.coalesce(inside, F.lit(False))
    counts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select(*counts, failed.alias("base_failed"), (~failed & fits).alias("kept"), "n_tokens", *MEASURES, "band")
