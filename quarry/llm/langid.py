"""Language identification of mixed-language text.

1. A word is a maximal run of letters of one script.  Every letter has one,
   from ranges of code points or Unicode's property; letters that Unicode gives
   no script of their own take that of the letters they stand at, or ``Zzzz``.
   The script narrows the candidates to the languages of the model that have at
   least SHARE of their training words in it, or most of them.  A script without
   a language in the model gives ``und-Cyrl`` and the like.
2. Each candidate scores the word by the log-probabilities of its hashed
   character trigrams; ``und`` scores a constant a letter, a little below what
   any language gives its own text.  A word's scores differ by at most CLIP.
3. Viterbi finds the labels of all words that maximise the sum of scores less
   ``penalty`` for each change of language; words of one label in a row form a
   span.  The path is exact: where no other language gains more than half a
   penalty in any stretch, the best single language is optimal (each change
   costs a penalty), and that is tested for whole batches at once; the other
   documents are decoded word by word.

``train`` counts trigrams of at most ``sample`` labelled rows of each language,
those with the least hash of their id.  Everything else reads all texts whole.

Defined results: a null, empty or wordless text has one span (0, length, 0
words, ``und``) and is rejected by ``accepted``; ties go to staying, then to
the language first in the alphabet; repeated rows get the same spans.  A very
long text is decoded whole.  Rows without a label are not trained on; with no
labelled row at all, every Latin word is ``und-Latn``.  An empty table gives no
spans.  Columns of df may have any names; a carried one must not be called span,
start, end, words or lang.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import _shared, _text

SAMPLE = 2000
BUCKETS = 1 << 16
PENALTY, CLIP, SLACK = 12.0, 6.0, 2.5
NEVER = -1000.0
#: Of a language's training words in a script, for it to be a candidate there.
SHARE = 0.1

#: (name, ranges of code points); of the Latin ranges only letters count.
SCRIPTS = (
    ("Latn", ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A))),
    ("Grek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("Cyrl", ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F))),
    ("Armn", ((0x530, 0x58F),)),
    ("Hebr", ((0x590, 0x5FF), (0xFB1D, 0xFB4F))),
    ("Arab", ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFE))),
    ("Deva", ((0x900, 0x97F), (0xA8E0, 0xA8FF))),
    ("Beng", ((0x980, 0x9FF),)),
    ("Taml", ((0xB80, 0xBFF),)),
    ("Thai", ((0xE00, 0xE7F),)),
    ("Geor", ((0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F))),
    ("Ethi", ((0x1200, 0x139F),)),
    ("Hang", ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF))),
    ("Kana", ((0x3041, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F))),
    ("Hani", ((0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF))),
)
#: Scripts of which letters and marks count by Unicode's property; Hira is one with Kana.
OTHERS = """Adlm Aghb Ahom Armi Avst Bali Bamu Bass Batk Berf Bhks Bopo Brah Brai Bugi Buhd Cakm Cans Cari Cham Cher Chrs Copt Cpmn
Cprt Diak Dogr Dsrt Dupl Egyp Elba Elym Gara Glag Gong Gonm Goth Gran Gujr Gukh Guru Hano Hatr Hluw Hmng Hmnp Hung Ital Java Jurc Kali
Kawi Khar Khmr Khoj Kits Knda Krai Kthi Lana Laoo Lepc Limb Lina Linb Lisu Lyci Lydi Mahj Maka Mand Mani Marc Medf Mend Merc Mero
Miao Mlym Modi Mong Mroo Mtei Mult Mymr Nagm Nand Narb Nbat Newa Nkoo Nshu Ogam Olck Onao Orkh Orya Osge Osma Ougr Palm Pauc Pcun Perm
Phag Phli Phlp Phnx Prti Rjng Rohg Runr Samr Sarb Saur Seal Sgnw Shaw Shrd Sidd Sidt Sind Sinh Sogd Sogo Sora Soyo Sund Sunu Sylo Syrc
Tagb Takr Tale Talu Tang Tavt Tayo Telu Tfng Tglg Thaa Tibt Tirh Tnsa Todr Tols Toto Tutg Ugar Vaii Vith Wara Wcho Xpeo Xsux Yezi
Yiii Zanb""".split()
NAMES = (*(name for name, _ in SCRIPTS), *OTHERS, "Zzzz")
_TABLE: list[np.ndarray] = []


def script_table() -> np.ndarray:
    """Number of the script of each code point, from 1; 0 where it is neither a letter nor a script's mark."""
    if not _TABLE:
        kind = _text.class_tables()[0]
        table = np.zeros(0x110000, np.uint8)
        for n, (_, ranges) in enumerate(SCRIPTS, 1):
            for lo, hi in ranges:
                table[lo : hi + 1] = np.where((kind[lo : hi + 1] == 1) | ((n > 1) & ((kind[lo : hi + 1] & 6) == 0)), n, 0)
        marks = np.zeros(0x110000, bool)
        marks[[ord(m) for m in regex.findall(r"\p{M}", "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000)))))]] = True
        rest = "".join(map(chr, np.flatnonzero(((kind == 1) | marks) & (table == 0)).tolist()))
        for code in (*NAMES[:-1], "Hira"):
            try:
                found = regex.findall(rf"\p{{Script={code}}}", rest)
            except regex.error:  # a script that an older library doesn't know
                continue
            at = np.fromiter(map(ord, found), np.int64, len(found))
            table[at[(code != "Latn") | (kind[at] == 1)]] = NAMES.index("Kana" if code == "Hira" else code) + 1
        table[(kind == 1) & (table == 0)] = len(NAMES)
        _TABLE.append(table)
    return _TABLE[0]


@dataclass(frozen=True)
class Model:
    """states: the languages, then und-Script of scripts without one, then und."""

    states: tuple[str, ...]
    allowed: np.ndarray  # (scripts + 1, states): whether a state is a candidate
    table: np.ndarray  # (BUCKETS, languages): log-probabilities
    floor: float  # the score of und for a letter

    @property
    def languages(self) -> int:
        return self.table.shape[1]


def adopt(script: np.ndarray, offsets: np.ndarray) -> None:
    """Give runs of letters without a script of their own that of the letter before them in their document, or else after them."""
    odd = np.flatnonzero(script == len(NAMES))
    if not len(odd):
        return
    first = np.concatenate([[True], (np.diff(odd) > 1) | np.isin(odd[1:], offsets)])
    start, end = odd[first], odd[np.append(first[1:], True)] + 1
    before = np.where(np.isin(start, offsets), 0, script[start - 1])
    after = np.where(np.isin(end, offsets), 0, script[np.minimum(end, len(script) - 1)])
    own = np.where(before > 0, before, np.where(after > 0, after, len(NAMES)))
    script[odd] = np.repeat(own, end - start)


def word_runs(cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, document and script of the words."""
    script = script_table()[cps]
    adopt(script, offsets)
    cut = np.ones(len(cps), bool)
    cut[1:] = script[1:] != script[:-1]
    cut[offsets[:-1][offsets[:-1] < len(cps)]] = True
    start = np.flatnonzero(cut)
    end = np.append(start[1:], len(cps))[: len(start)]
    real = script[start] > 0 if len(start) else np.zeros(0, bool)
    start, end = start[real], end[real]
    return start, end, np.searchsorted(offsets, start, side="right") - 1, script[start]


def trigrams(cps: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams around each letter of the words, with blanks outside them, and the words' first ones."""
    size = end - start
    begin = np.cumsum(size) - size
    at = np.repeat(start - begin, size) + np.arange(int(size.sum()))
    c = _text.class_tables()[1][cps[at]].astype(np.uint64)
    left, right = np.roll(c, 1), np.roll(c, -1)
    left[begin] = 32
    right[begin + size - 1] = 32
    h = (left * np.uint64(0x9E3779B97F4A7C15) ^ c * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xD6E8FEB86659FD93) + right * np.uint64(0xA0761D6478BD642F)
    h ^= h >> np.uint64(29)
    return (h * np.uint64(0xE7037ED1A0B428DB) >> np.uint64(48)).astype(np.int64), begin


# --- the model
def trigram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(counts by bucket, counts of words by script)."""
    counts, scripts = np.zeros(BUCKETS, np.int64), np.zeros(len(NAMES) + 1, np.int64)
    for lo, hi in _text.slices(texts):
        cps, offsets = _text.code_points(texts[lo:hi])
        start, end, _, script = word_runs(cps, offsets)
        if len(start):
            counts += np.bincount(trigrams(cps, start, end)[0], minlength=BUCKETS)
            scripts += np.bincount(script, minlength=len(scripts))
    return counts, scripts


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """A model from trigram and script counts by language."""
    langs = sorted(k for k, (c, _) in counts.items() if c.sum())
    table = np.zeros((BUCKETS, len(langs)), np.float32)
    own: dict[str, set[int]] = {}
    floor = 0.0
    for i, lang in enumerate(langs):
        c, s = counts[lang]
        p = (c + 0.1) / (c.sum() + 0.1 * BUCKETS)
        table[:, i] = np.log(p)
        floor = min(floor, float((c * np.log(p)).sum() / c.sum()))
        own[lang] = {int(np.argmax(s)), *np.flatnonzero(s >= max(1, SHARE * s.sum())).tolist()}
    bare = [n for n in range(1, len(NAMES) + 1) if n not in set().union(*own.values())]
    states = (*langs, *(f"und-{NAMES[n - 1]}" for n in bare), "und")
    allowed = np.zeros((len(NAMES) + 1, len(states)), bool)
    allowed[:, -1] = True
    for i, lang in enumerate(langs):
        allowed[sorted(own[lang]), i] = True
    for i, n in enumerate(bare):
        allowed[n, len(langs) + i] = True
        allowed[n, -1] = False
    return Model(states, allowed, table, floor - SLACK)


def train(df: DataFrame, text: str = "text", label: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows of each language."""
    first = Window.partitionBy("lang").orderBy("h")
    chosen = df.select(F.col(label).alias("lang"), F.xxhash64(F.col(doc_id).cast("string")).alias("h")).where("lang IS NOT NULL").withColumn("n", F.row_number().over(first)).where(F.col("n") <= sample).select("lang", "h").distinct()
    rows = df.select(F.col(label).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(doc_id).cast("string")).alias("h")).where("lang IS NOT NULL AND text IS NOT NULL").join(F.broadcast(chosen), ["lang", "h"], "left_semi").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            langs = b.column(0).to_pylist()
            texts = b.column(1).to_pylist()
            for lang in set(langs):
                c, s = trigram_counts([t for t, x in zip(texts, langs, strict=True) if x == lang])
                old = total.get(lang)
                total[lang] = (c, s) if old is None else (old[0] + c, old[1] + s)
        for lang, (c, s) in total.items():
            for kind, values in ((0, c), (1, s)):
                at = np.flatnonzero(values)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int32)), pa.array(values[at])], names=["lang", "kind", "bucket", "n"])

    got: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    # At most languages * (BUCKETS + scripts) rows, whatever the input.
    counted = rows.mapInArrow(count, "lang string, kind int, bucket int, n long").groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n")).toArrow()
    lang, kind, bucket, n = (counted.column(i).to_numpy(zero_copy_only=False) for i in range(4))
    for name in sorted(set(lang.tolist())):
        c, s = np.zeros(BUCKETS, np.int64), np.zeros(len(NAMES) + 1, np.int64)
        for k, values in ((0, c), (1, s)):
            mine = (lang == name) & (kind == k)
            values[bucket[mine]] = n[mine]
        got[name] = c, s
    return build(got)


# --- decoding
def candidates(model: Model, script: np.ndarray) -> np.ndarray:
    """The states that any of the scripts allows; no path takes another."""
    return np.flatnonzero(model.allowed[np.flatnonzero(np.bincount(script, minlength=1))].any(axis=0))


def word_scores(model: Model, cps: np.ndarray, start: np.ndarray, end: np.ndarray, script: np.ndarray, states: np.ndarray | None = None) -> np.ndarray:
    """(words, states) scores, of all states or of the given ones; NEVER where the script excludes the state."""
    states = np.arange(len(model.states)) if states is None else states
    s = np.zeros((len(start), len(states)))
    known = states[states < model.languages]
    if len(known):
        bucket, begin = trigrams(cps, start, end)
        table = model.table if len(known) == model.languages else model.table[:, known]
        s[:, : len(known)] = np.add.reduceat(table[bucket], begin, axis=0)
    s[:, states == len(model.states) - 1] = (model.floor * (end - start))[:, None]
    allowed = model.allowed[:, states][script]
    s[~allowed] = -np.inf
    top = s.max(axis=1, keepdims=True)
    s = np.maximum(s - top, -CLIP)
    s[~allowed] = NEVER
    return s


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The states that maximise the sum of scores less a penalty for each change."""
    n, k = scores.shape
    value = scores[0].tolist()
    came: list[tuple[int, list[bool]]] = []
    for row in scores[1:].tolist():
        best = max(range(k), key=value.__getitem__)
        jump = value[best] - penalty
        stay = [v >= jump for v in value]
        value = [(v if s else jump) + x for v, s, x in zip(value, stay, row, strict=True)]
        came.append((best, stay))
    path = np.empty(n, np.int64)
    state = max(range(k), key=value.__getitem__)
    path[-1] = state
    for i in range(n - 2, -1, -1):
        best, stay = came[i]
        if not stay[state]:
            state = best
        path[i] = state
    return path


def decode(scores: np.ndarray, edges: np.ndarray, penalty: float) -> np.ndarray:
    """Viterbi over each document's words, scores[edges[d] : edges[d + 1]]."""
    size = np.diff(edges)
    real = np.flatnonzero(size)
    path = np.zeros(len(scores), np.int64)
    if not len(real):
        return path
    begin = edges[:-1][real]
    total = np.add.reduceat(scores, begin, axis=0)
    best = total.argmax(axis=1)
    path[:] = np.repeat(best, size[real])
    own = scores[np.arange(len(scores)), path]
    # A stretch that gains begins and ends at words where another state is better: what lies between two such is one item.
    other = own < scores.max(axis=1)
    cut = np.zeros(len(scores) + 1, bool)
    cut[begin] = True
    cut[:-1] |= other
    cut[1:] |= other
    item = np.flatnonzero(cut[:-1])
    gain = np.add.reduceat(scores, item, axis=0) - np.add.reduceat(own, item)[:, None]
    first = np.searchsorted(item, begin)
    # The greatest sum of a stretch of one document: a running minimum that falls by more than any sum from document to document.
    fall = 2 * (np.abs(gain).sum(axis=0).max() + 1)
    drop = np.repeat(np.arange(len(real)), np.diff(np.append(first, len(item))))[:, None] * fall
    after = np.cumsum(gain, axis=0) - drop
    before = after - gain
    stretch = np.maximum.reduceat((after - np.minimum.accumulate(before, axis=0)).max(axis=1), first)
    for d in np.flatnonzero(stretch > penalty / 2).tolist():
        a = begin[d]
        path[a : a + size[real[d]]] = viterbi(scores[a : a + size[real[d]]], penalty)
    return path


def label(model: Model, texts: list[str], penalty: float = PENALTY) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of the texts: (index of the first, then of each span the text, start, end, words, state)."""
    for lo, hi in _text.slices(texts):
        cps, offsets = _text.code_points(texts[lo:hi])
        start, end, doc, script = word_runs(cps, offsets)
        edges = _text.by_document(doc, hi - lo)
        none = np.flatnonzero(np.diff(edges) == 0)
        if len(start):
            states = candidates(model, script)
            path = states[decode(word_scores(model, cps, start, end, script, states), edges, penalty)]
            new = np.ones(len(path), bool)
            new[1:] = (path[1:] != path[:-1]) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(path)) - 1
        else:
            path = first = last = np.zeros(0, np.int64)
        d = np.concatenate([doc[first], none])
        parts = (np.concatenate([start[first] - offsets[doc[first]], np.zeros(len(none), np.int64)]), np.concatenate([end[last] - offsets[doc[first]], np.diff(offsets)[none]]), np.concatenate([last - first + 1, np.zeros(len(none), np.int64)]), np.concatenate([path[first], np.full(len(none), len(model.states) - 1)]))
        order = np.argsort(d, kind="stable")
        yield lo, d[order], *(p[order] for p in parts)


def spans(df: DataFrame, model: Model, text: str = "text", carry: tuple[str, ...] = ("doc_id",), penalty: float = PENALTY) -> DataFrame:
    """A row (carried columns, span, start, end, words, lang) for each span; start and end count characters."""
    kept = df.select(*carry, df[text].alias(_shared.fresh(list(carry), "__text")[0]))
    long = [T.StructField(n, T.LongType()) for n in ("start", "end", "words")]
    schema = T.StructType([*(kept.schema[c] for c in carry), T.StructField("span", T.LongType()), *long, T.StructField("lang", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(model.states)
        for batch in batches:
            for lo, doc, start, end, words, state in label(model, _text.strings(batch.column(len(carry))), penalty):
                number = np.arange(len(doc)) - np.searchsorted(doc, doc)
                rows = pa.array(doc + lo)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(rows) for i in range(len(carry))), *map(pa.array, (number, start, end, words)), names.take(pa.array(state))], names=schema.names)

    return kept.mapInArrow(run, schema)


def accepted(text: Column, model: Model, penalty: float = PENALTY, share: float = 0.25) -> Column:
    """Whether at least ``share`` of a text's words lie in spans of the model's languages; false without a word."""

    @F.arrow_udf(T.BooleanType())
    def run(column: pa.Array) -> pa.Array:
        texts = _text.strings(column)
        out = np.zeros(len(texts), bool)
        for lo, doc, _, _, words, state in label(model, texts, penalty):
            n = int(doc[-1]) + 1 if len(doc) else 0
            known = np.bincount(doc, words * (state < model.languages), n)
            total = np.bincount(doc, words, n)
            out[lo : lo + n] = (total > 0) & (known >= share * total)
        del texts
        _text.release()
        return pa.array(out)

    return run(text)


def keep_identified(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of df whose text is accepted, with all their columns."""
    return df.where(accepted(df[text], model))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spans(docs, train(docs))
