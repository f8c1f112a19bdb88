"""The language of each document and of each passage of a document that mixes languages, by compression.

Every language has a raw-content dictionary of its own text; a passage belongs to the language whose dictionary lets
zstandard write it shortest. Passages are first cut where the script changes; within a script that several languages
share, eight-word windows written under each of them show where the language changes.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import textform as tf

#: Three-letter codes with the codes that documents have (fixed values).
THREE_LETTER = {"tam": "ta", "eng": "en", "hin": "hi", "mar": "mr", "tel": "te", "mal": "ml"}
MISSING = ("", "und")


@dataclass(frozen=True)
class LanguageConfig:
    """share: a label names a language if at least this share of the labelled documents carry it; sample: documents a language
    is trained on at most, longest: characters of such a document at most; dictionary: bytes of a dictionary, taken evenly
    from all sample documents in stretches of ``stretch`` words; rounds: passes that drop sample documents of another
    language than their label, at last those with passages of another; level: of the compressor; passage: fewest words of a passage;
    window, step: words of a window and between windows; slack: bytes by which a window must speak for another
    language before a passage is looked at closely; switch: bytes a change of language costs; margin: share by which
    the second-best language must be longer, else the passage has no language."""

    share: float = 0.005
    sample: int = 300
    longest: int = 20_000
    dictionary: int = 110_000
    stretch: int = 24
    rounds: int = 3
    level: int = 3
    passage: int = 15
    window: int = 8
    step: int = 2
    slack: int = 1
    switch: float = 4.0
    margin: float = 0.01
    seed: int = 5


def label_code(label: Column) -> Column:
    """The language a label names, as a code of two letters where one is known; null for a missing label.

    Case, region, ``_`` for ``-`` and three-letter codes don't matter; Tamil with a subtag ``latn`` is ta-Latn.
    """
    tags = F.split(F.regexp_replace(F.lower(F.trim(label)), "_", "-"), "-")
    two = F.create_map(*[F.lit(x) for pair in THREE_LETTER.items() for x in pair])
    first = F.coalesce(F.try_element_at(two, tags[0]), tags[0])
    script = F.when(F.array_contains(tags, "latn") & (tags[0] != "en"), F.lit("-Latn")).otherwise(F.lit(""))
    return F.when(~F.lower(F.trim(label)).isin(*MISSING), F.concat(first, script))


class Languages:
    """Compressors of the languages; can be sent to workers."""

    def __init__(self, texts: dict[str, list[list[str]]], config: LanguageConfig) -> None:
        self.config = config
        self.names = sorted(texts)
        texts = {k: [list(w) for w in dict.fromkeys(map(tuple, v))] for k, v in texts.items()}
        kept = texts
        for step in range(config.rounds):
            # Each half is judged by dictionaries of the other, or a text would find itself. In the last step texts that hold
            # passages of another language go too: they would make those passages look like their label.
            left: dict[str, list[list[str]]] = {k: [] for k in self.names}
            for half in (0, 1):
                self._fill({k: [w for i, w in enumerate(texts[k]) if i % 2 != half and w in kept[k]] for k in self.names})
                for k in self.names:
                    for w in texts[k][half::2]:
                        if step < config.rounds - 1:
                            good = self.names[int(self.sizes(w).argmin())] == k
                        else:
                            good = all(name == k for _, _, name, _ in self.passages(w))
                        if good:
                            left[k].append(w)
            kept = {k: left[k] or kept[k] for k in self.names}
        self._fill(kept)

    def _fill(self, texts: dict[str, list[list[str]]]) -> None:
        self.data = {k: self._drawn(v) for k, v in texts.items()}
        self.script = {}
        for k, v in texts.items():
            held = Counter(filter(None, (word_script(w) for words in v for w in words)))
            self.script[k] = held.most_common(1)[0][0] if held else ""
        self._open()

    def _drawn(self, texts: list[list[str]]) -> bytes:
        """Stretches of all texts at even distances, as many as the dictionary holds."""
        n, limit = self.config.stretch, self.config.dictionary
        pieces = [" ".join(w[i : i + n]).encode() for w in texts for i in range(0, len(w), n)]
        step = max(1.0, sum(len(p) + 1 for p in pieces) / limit)
        kept = [pieces[int(i * step)] for i in range(int(len(pieces) / step))]
        return b" ".join(kept)[:limit]

    def _open(self) -> None:
        self.made = []
        for k in self.names:
            d = zstandard.ZstdCompressionDict(self.data[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=self.config.level)
            p = zstandard.ZstdCompressionParameters.from_level(
                self.config.level, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False
            )
            self.made.append(zstandard.ZstdCompressor(dict_data=d, compression_params=p))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "made"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._open()

    def sizes(self, words: list[str], only: list[int] | None = None) -> np.ndarray:
        text = (" " + " ".join(words)).encode()
        return np.array([len(self.made[k].compress(text)) for k in (range(len(self.made)) if only is None else only)], float)

    def passages(self, words: list[str]) -> list[tuple[int, int, str | None, float]]:
        """(first word, words, language or None, confidence) of the passages of a text, in order."""
        out = []
        if not self.names:
            return [(a, b - a, None, 0.0) for a, b, _ in script_runs(words, self.config.passage)]
        for start, end, script in script_runs(words, self.config.passage):
            part = words[start:end]
            sizes = self.sizes(part)
            order = sizes.argsort(kind="stable")
            best, second = int(order[0]), int(order[1]) if len(order) > 1 else int(order[0])
            sharing = [k for k, name in enumerate(self.names) if self.script[name] == script]
            cuts = [(0, len(part), best)]
            if len(sharing) > 1 and best in sharing and len(part) >= 2 * self.config.passage:
                cuts = self._changes(part, sharing, best)
            for a, b, k in cuts:
                if len(cuts) > 1:
                    sizes = self.sizes(part[a:b])
                    order = sizes.argsort(kind="stable")
                    k, second = int(order[0]), int(order[1])
                gap = (sizes[second] - sizes[k]) / max(sizes[k], 1.0) if second != k else 1.0  # one language: no rival
                sure = float(1 / np.exp2(-np.minimum(sizes - sizes[k], 60)).sum())
                out.append((start + a, b - a, self.names[k] if gap >= self.config.margin else None, sure))
        return out

    def _changes(self, words: list[str], sharing: list[int], best: int) -> list[tuple[int, int, int]]:
        c, n = self.config, len(words)
        at = sharing.index(best)
        for i in range(0, n - c.window + 1, c.window):  # a passage of another language fills one of these windows
            s = self.sizes(words[i : i + c.window], sharing)
            if s.min() < s[at] - c.slack:
                break
        else:
            return [(0, n, best)]
        total, seen = np.zeros((n, len(sharing))), np.zeros((n, 1))
        for i in [*range(0, n - c.window, c.step), n - c.window]:
            s = self.sizes(words[i : i + c.window], sharing)
            total[i : i + c.window] += s - s.min()
            seen[i : i + c.window] += 1
        cost = total / seen / c.window
        paid, back = cost[0].copy(), np.zeros((n, len(sharing)), int)
        for i in range(1, n):
            change = paid.min() + c.switch
            back[i] = np.where(paid <= change, np.arange(len(sharing)), paid.argmin())
            paid = np.minimum(paid, change) + cost[i]
        path = [int(paid.argmin())]
        for i in range(n - 1, 0, -1):
            path.append(int(back[i][path[-1]]))
        runs = absorb([[k, len(list(g))] for k, g in groupby(reversed(path))], c.passage)
        out, i = [], 0
        for k, length in runs:
            out.append((i, i + length, sharing[k]))
            i += length
        return out


_SCRIPTS: dict[str, str] = {}


def word_script(word: str) -> str:
    """The script of a word's first letter; '' for numbers."""
    for c in word:
        s = _SCRIPTS.get(c)
        if s is None:
            s = _SCRIPTS[c] = tf.script_block(c) if c.isalpha() else ""
        if s:
            return s
    return ""


def absorb(runs: list[list], least: int) -> list[list]:
    """Runs [mark, length] without those shorter than ``least``: each goes, shortest first (the first of equal ones), to its
    longer neighbour (the one before if they are equal), and neighbours of one mark become one run.

    Runs are a linked list and the shortest is found in a heap, so a text of many runs takes little more than its length.
    """
    mark, length = [r[0] for r in runs], [r[1] for r in runs]
    before, after = list(range(-1, len(runs) - 1)), [*range(1, len(runs)), -1]
    heap, alive = [(n, i) for i, n in enumerate(length)], len(runs)
    heapq.heapify(heap)

    def drop(i: int) -> None:
        if before[i] >= 0:
            after[before[i]] = after[i]
        if after[i] >= 0:
            before[after[i]] = before[i]
        length[i] = 0

    while alive > 1:
        n, i = heapq.heappop(heap)
        if length[i] != n:
            continue  # it has grown or gone since
        if n >= least:
            break
        left, right = before[i], after[i]
        to = right if left < 0 or right >= 0 and length[right] > length[left] else left
        length[to] += n
        drop(i)
        alive -= 1
        if left >= 0 and right >= 0 and mark[left] == mark[right]:
            length[left] += length[right]
            drop(right)
            alive -= 1
            to = left
        heapq.heappush(heap, (length[to], to))
    return [[m, n] for m, n in zip(mark, length, strict=True) if n]


def script_runs(words: list[str], least: int) -> list[tuple[int, int, str]]:
    """(start, end, script) of the stretches of a text in one script; shorter ones than ``least`` belong to what is around."""
    runs: list[list] = []
    loose = 0  # words without letters before the first word with letters
    for s, g in groupby(map(word_script, words)):
        n = len(list(g))
        if runs and (not s or runs[-1][0] == s):
            runs[-1][1] += n
        elif not s:
            loose += n
        else:
            runs.append([s, n + loose])
            loose = 0
    out, i = [], 0
    for s, n in absorb(runs, least):
        out.append((i, i + n, s))
        i += n
    return out


def train(documents: DataFrame, config: LanguageConfig = LanguageConfig()) -> Languages:
    """Dictionaries from at most about ``sample`` labelled documents a language, chosen by a hash of doc_id.

    Languages are those that labels name, but for labels that less than ``share`` of the labelled documents carry. Labels may
    be wrong in places: sample documents that another language writes shorter are left out. If no document carries a label,
    no language is known, and passages have none.
    """
    rows = documents.select("doc_id", "text", label_code(F.col("lang")).alias("code")).where(F.col("code").isNotNull() & F.length("text").between(1, config.longest))
    most = max(1, math.floor(1 / config.share))  # no more labels can have that share
    counts = {r["code"]: r["count"] for r in rows.groupBy("code").count().orderBy(F.col("count").desc(), "code").limit(most).collect()}
    total = rows.count()
    counts = {k: n for k, n in counts.items() if n >= config.share * total}
    if not counts:
        return Languages({}, config)
    rows = rows.where(F.col("code").isin(*counts))
    share = F.create_map(*[F.lit(x) for code, n in counts.items() for x in (code, min(1.0, config.sample / n))])
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(config.seed)), F.lit(1 << 30)) / float(1 << 30) < F.element_at(share, F.col("code")))
    texts: dict[str, list[tuple[int, list[str]]]] = {}
    for r in drawn.collect():  # the bounded sample
        texts.setdefault(r["code"], []).append((r["doc_id"], tf.words(r["text"])))
    return Languages({k: [w for _, w in sorted(v)] for k, v in texts.items()}, config)


PASSAGES = "doc_id long, passage int, first_word int, words int, language string, confidence double"


def passages(documents: DataFrame, languages: Languages) -> DataFrame:
    """One row per passage: doc_id, passage (from 0), first_word, words, language, confidence.

    language is null where the two best are too close. Texts that are null or hold no letters have no passage. A text of
    fewer words than a passage needs is one passage.
    """
    spread = documents.sparkSession.sparkContext.broadcast(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = spread.value
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i, (first, n, name, sure) in enumerate(held.passages(tf.words(text))):
                    rows.append((doc, i, first, n, name, sure))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64()]
            names = ["doc_id", "passage", "first_word", "words", "language", "confidence"]
            yield pa.record_batch({k: pa.array(v, t) for k, v, t in zip(names, columns, types, strict=True)})

    return documents.select("doc_id", "text").mapInArrow(run, PASSAGES)


def relabelled(documents: DataFrame, languages: Languages) -> DataFrame:
    """(doc_id, language): the languages of documents whose label is missing or names another, or that mix several."""
    held = passages(documents, languages).where("language is not null").groupBy("doc_id").agg(F.collect_set("language").alias("held"))
    both = held.join(documents.select("doc_id", label_code(F.col("lang")).alias("code")), "doc_id")
    wrong = F.col("code").isNull() | (F.size("held") > 1) | ~F.array_contains("held", F.col("code"))
    return both.where(wrong).select("doc_id", F.explode("held").alias("language"))
