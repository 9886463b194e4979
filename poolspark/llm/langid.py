"""Language of words and texts by a linear-chain conditional random field (operator 10).

Every word gets a language; neighbours are tied by learned transitions, so that code-switched text falls
into runs. Emission features of a word: the word itself, its affixes (1 to 4 bytes at either end), its byte
3-grams, and the languages whose lexicon (frequent words of the training sample) holds it, all hashed.
Emissions are worked out once per distinct word; the chain is summed by forward-backward.

The texts of a piece are cut into blocks of ``BLOCK`` words. The product of the transfer matrices of each
block is taken for all blocks at once, the block ends of a text are linked through these products, and the
inside of all blocks follows at once again: exact marginals for texts of any length without a step per word
and text.

Training has the language of a whole text only. Sequences are made of spans of several sampled texts, one
after the other, each word with the language of its text; so the transitions see switches. The sample is
bounded and learnt from in one task with adaptive rates: ``rows`` texts in equal shares of the languages, at
least one of each, and ``SPAN`` words a text. A longer text gives stretches spread evenly from its first word
to its last one.

Defined results: a text that is null or has no letter is ``und`` with score 0 and no runs; a language that is
null is not learnt from; without any training row all texts are ``und``; ties go to the language that sorts
first; repeated rows score alike and are learnt from once; an id on several texts is several rows; other columns
stay, the outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from poolspark.llm import store
from poolspark.llm import words as W

U64 = np.uint64
ROWS = 4_000  # texts of the training sample
SPAN = 2_000  # words of a sampled text that are trained on, in stretches spread over all of it
STRETCH = 40
BITS = 18
LEXICON = 300
BLOCK = 64
UNDETERMINED = "und"
OUTPUTS = ["lang_pred", "score", "runs"]
_CACHE_LIMIT = 1_000_000


def _hash(x: np.ndarray, salt: int) -> np.ndarray:
    return (W.mix(x ^ U64(salt)) >> U64(64 - BITS)).astype(np.int64)


def word_features(data: np.ndarray, start: np.ndarray, end: np.ndarray, lexicon: dict) -> tuple[np.ndarray, np.ndarray]:
    """(feature, word) of words given as ascending spans; at least one feature per word, words ascending."""
    number = np.arange(len(start))
    own = W.span_hashes(data, start, end)
    found, owner = [_hash(own, 1)], [number]
    size = end - start
    for n in (1, 2, 3, 4):
        for side in (0, 1):
            long = size >= n
            a = start[long] if side == 0 else end[long] - n
            found.append(_hash(W.span_hashes(data, a, a + n), 10 + 2 * n + side))
            owner.append(number[long])
    inner = np.maximum(size - 2, 0)
    stop = np.cumsum(inner)
    at = np.repeat(start - (stop - inner), inner) + np.arange(int(stop[-1]) if len(stop) else 0)
    wide = data.astype(U64)
    grams = wide[at] | (wide[np.minimum(at + 1, len(data) - 1)] << U64(8)) | (wide[np.minimum(at + 2, len(data) - 1)] << U64(16))
    found.append(_hash(grams, 40))
    owner.append(np.repeat(number, inner))
    if len(lexicon["word"]):
        where = np.minimum(np.searchsorted(lexicon["word"], own), len(lexicon["word"]) - 1)
        hit = lexicon["word"][where] == own
        found.append(_hash(lexicon["langs"][where[hit]].astype(U64), 60))
        owner.append(number[hit])
    feature, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return feature[order], owner[order]


@dataclass
class Model:
    langs: list[str]
    weight: np.ndarray  # 2^BITS x languages
    transition: np.ndarray  # from x to, as logarithms
    lexicon: dict
    _cache: dict = field(default_factory=dict)

    def emissions(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Emission scores of every word, from the worker's cache where it has been seen."""
        hashes = W.span_hashes(data, start, end)
        distinct, sample, back = np.unique(hashes, return_index=True, return_inverse=True)
        key = self._cache.get("key", np.zeros(0, U64))
        if len(key) + len(distinct) > _CACHE_LIMIT:
            key = np.zeros(0, U64)
        value = self._cache["value"] if len(key) else np.zeros((0, len(self.langs)), np.float32)
        where = np.searchsorted(key, distinct)
        new = np.ones(len(distinct), bool)
        inside = where < len(key)
        new[inside] = key[where[inside]] != distinct[inside]
        if new.any():
            pick = np.sort(sample[new])
            feature, owner = word_features(data, start[pick], end[pick], self.lexicon)
            head = np.searchsorted(owner, np.arange(len(pick)))
            fresh = np.add.reduceat(self.weight[feature], head, axis=0)
            fresh = fresh[np.searchsorted(pick, sample[new])]
            key, value = np.insert(key, where[new], distinct[new]), np.insert(value, where[new], fresh, axis=0)
            where = np.searchsorted(key, distinct)
        self._cache.update(key=key, value=value)
        return value[where][back].astype(np.float64)


def marginals(emission: np.ndarray, size: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """P(language | text) of every word; ``size``: words per text, each at least 1."""
    k = emission.shape[1]
    step = np.exp(transition - transition.max())
    e = np.exp(emission - emission.max(1, keepdims=True))
    blocks = (size + BLOCK - 1) // BLOCK
    n = int(blocks.sum())
    first = np.cumsum(blocks) - blocks
    within = np.arange(n) - np.repeat(first, blocks)
    room = np.full(n, BLOCK)
    room[first + blocks - 1] = size - BLOCK * (blocks - 1)
    begin = np.cumsum(room) - room
    grid = np.minimum(begin[:, None] + np.arange(BLOCK), len(e) - 1)
    emit = e[grid]  # blocks x BLOCK x languages
    live = np.arange(BLOCK) < room[:, None]
    product = np.broadcast_to(np.eye(k), (n, k, k)).copy()
    for t in range(BLOCK):
        go = slice(None) if live[:, t].all() else live[:, t]
        nxt = (product[go].reshape(-1, k) @ step).reshape(-1, k, k) * emit[go, t, None, :]
        product[go] = nxt / nxt.sum((1, 2), keepdims=True)
    ahead = np.full((n, k), 1.0 / k)
    behind = np.ones((n, k))
    order = np.argsort(-blocks, kind="stable")
    count = -blocks[order]
    for j in range(1, int(blocks.max())):
        b = first[order[:np.searchsorted(count, -j, "left")]] + j  # texts with more than j blocks
        x = np.einsum("bi,bij->bj", ahead[b - 1], product[b - 1])
        ahead[b] = x / x.sum(1, keepdims=True)
    for j in range(int(blocks.max()) - 2, -1, -1):
        b = first[order[:np.searchsorted(count, -(j + 1), "left")]] + j
        x = np.einsum("bij,bj->bi", product[b + 1], behind[b + 1])
        behind[b] = x / x.sum(1, keepdims=True)
    out = np.empty((n, BLOCK, k))
    state = ahead
    for t in range(BLOCK):
        state = (state @ step) * emit[:, t]
        state = state / state.sum(1, keepdims=True)
        out[:, t] = state
    state = behind
    for t in range(BLOCK - 1, -1, -1):
        on = live[:, t, None]
        out[:, t] = np.where(on, out[:, t] * state, 0.0)
        nxt = (emit[:, t] * state) @ step.T
        state = np.where(on, nxt / nxt.sum(1, keepdims=True), state)
    flat = out[live]
    return flat / flat.sum(1, keepdims=True)


def _words(column: pa.Array):
    data, offsets = W.texts(column)
    start, end, doc = W.spans(data, offsets, W.PUNCTUATION)
    return data, start, end, doc


def stretches(n: int, span: int = SPAN, size: int = STRETCH) -> np.ndarray:
    """(first, last) words to learn from in a text of ``n`` words: all, or ``span`` words in stretches spread evenly over it."""
    if n <= span:
        return np.array([[0, n - 1]])
    count = span // size
    first = np.arange(count) * (n - size) // (count - 1)
    return np.stack([first, first + size - 1], 1)


def _learn(rows: list[tuple[str, bytes]], epochs: int, rate: float, l2: float) -> Model:
    langs = sorted({lang for lang, _ in rows})
    label = {lang: i for i, lang in enumerate(langs)}
    data = np.frombuffer(b"\n".join(t for _, t in rows), np.uint8)
    offsets = np.cumsum([0, *[len(t) + 1 for _, t in rows]])
    offsets[-1] -= 1
    start, end, doc = W.spans(data, offsets, W.PUNCTUATION)
    lang = np.array([label[x] for x, _ in rows])[doc]
    hashes = W.span_hashes(data, start, end)
    # Lexicon: for each language its most frequent words; a word's value is the set of languages that list it.
    # The set is written as the sum of a random number per language, so any number of languages can be told apart.
    members: dict[int, int] = {}
    mark = W.mix(np.arange(1, len(langs) + 1, dtype=U64)).tolist()
    for i in range(len(langs)):
        words, n = W.counted(hashes[lang == i])
        for w in words[np.argsort(-n, kind="stable")[:LEXICON]].tolist():
            members[w] = (members.get(w, 0) + mark[i]) & (1 << 64) - 1
    lexicon = {"word": np.array(sorted(members), U64), "langs": np.array([members[w] for w in sorted(members)], U64)}
    distinct, sample, back = np.unique(hashes, return_index=True, return_inverse=True)
    place = np.argsort(sample)
    rank = np.empty(len(place), np.int64)
    rank[place] = np.arange(len(place))
    word = rank[back]  # distinct words are numbered by their first place
    feature, owner = word_features(data, start[np.sort(sample)], end[np.sort(sample)], lexicon)
    edge = np.searchsorted(owner, np.arange(len(distinct) + 1))

    k = len(langs)
    weight, spent = np.zeros((1 << BITS, k)), np.full((1 << BITS, k), 1e-2)
    transition, tspent = np.zeros((k, k)), np.full((k, k), 1e-2)
    rng = np.random.default_rng(1)
    # Spans of 5 to 40 words; a sequence of 128 words is made of spans in random order.
    cuts = np.unique(np.concatenate([np.searchsorted(doc, np.arange(doc[-1] + 1)), np.cumsum(rng.integers(5, 41, 1 + len(doc) // 5))]))
    cuts = cuts[cuts < len(doc)]
    length = np.diff(np.append(cuts, len(doc)))
    for _ in range(epochs):
        by = rng.permutation(len(cuts))
        stop = np.cumsum(length[by])
        order = np.repeat(cuts[by] - (stop - length[by]), length[by]) + np.arange(len(doc))
        for lo in range(0, len(order), 128 * 32):
            at = order[lo:lo + 128 * 32]
            used, inner = np.unique(word[at], return_inverse=True)
            n = edge[used + 1] - edge[used]
            stop = np.cumsum(n)
            flat = feature[np.repeat(edge[used] - (stop - n), n) + np.arange(stop[-1])]
            emission = np.add.reduceat(weight[flat], stop - n, axis=0)
            size = np.full(-(-len(at) // 128), 128)
            size[-1] = len(at) - 128 * (len(size) - 1)
            gold = np.zeros((len(at), k))
            gold[np.arange(len(at)), lang[at]] = 1
            p, pairs, seen = _expected(emission[inner], gold, size, transition)
            slope = np.stack([np.bincount(inner, weights=(p - gold)[:, i], minlength=len(used)) for i in range(k)], 1)
            touched, back_f = np.unique(flat, return_inverse=True)
            g = np.stack([np.bincount(back_f, weights=np.repeat(slope[:, i], n), minlength=len(touched)) for i in range(k)], 1) + l2 * weight[touched]
            spent[touched] += g * g
            weight[touched] -= rate * g / np.sqrt(spent[touched])
            g = pairs - seen + l2 * transition
            tspent += g * g
            transition -= rate * g / np.sqrt(tspent)
    return Model(langs, weight.astype(np.float32), transition, lexicon)


def _expected(emission, gold, size, transition):
    """Marginals, expected transition counts and the counts of the training labels, for sequences of 128 words or less."""
    k = emission.shape[1]
    n, longest = len(size), int(size.max())
    e = np.ones((n, longest, k))
    live = np.arange(longest) < size[:, None]
    e[live] = np.exp(emission - emission.max(1, keepdims=True))
    step = np.exp(transition - transition.max())
    ahead, behind = np.empty((n, longest, k)), np.ones((n, longest, k))
    state = np.full((n, k), 1.0 / k)
    for t in range(longest):
        state = (state @ step) * e[:, t]
        state /= state.sum(1, keepdims=True)
        ahead[:, t] = state
    for t in range(longest - 2, -1, -1):
        nxt = (e[:, t + 1] * behind[:, t + 1]) @ step.T
        behind[:, t] = np.where(live[:, t + 1, None], nxt / nxt.sum(1, keepdims=True), 1.0)
    p = (ahead * behind)[live]
    p /= p.sum(1, keepdims=True)
    joint = ahead[:, :-1, :, None] * step * (e[:, 1:] * behind[:, 1:])[:, :, None, :]
    joint /= joint.sum((2, 3), keepdims=True)
    pairs = joint[live[:, 1:]].sum(0)
    own = np.zeros((n, longest, k))
    own[live] = gold
    seen = np.einsum("nti,ntj->ij", own[:, :-1], own[:, 1:])
    # Before the first word stands an unseen one of any language, so its transitions count by their share.
    share, first = step / step.sum(0), np.cumsum(size) - size
    return p, pairs + share * p[first].sum(0), seen + share * gold[first].sum(0)


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", rows: int = ROWS, epochs: int = 2, rate: float = 0.2,
        l2: float = 0.01) -> Model:
    """Learn from at most ``rows`` texts of ``docs`` (one of each language, should there be more languages than that).

    Every language has the same share, its rows with the smallest hash of id and text. Equal rows are one.
    """
    usable = docs.select(F.col(key).cast("long").alias("k"), F.col(lang).cast("string").alias("y"),
                         F.lower(F.col(text).cast("string")).alias("t")).where("k is not null and y is not null and t is not null")
    marked = usable.select(F.xxhash64("k", "t").alias("o"), "y", "t")
    slim = marked.select("o", "y")
    # The model holds 2^18 weights a language; a name and a number of each are far smaller.
    sizes = slim.groupBy("y").agg(F.approx_count_distinct("o", 0.02).alias("n"))
    share = max(1, rows // max(1, slim.select("y").distinct().count()))
    # Hashes are even, so those below this cut hold four times the share (and all rows of a small language): the rows
    # ranked by language are few, whatever the table.
    below = F.col("o") / F.lit(2.0**64) + 0.5 <= (4 * share + 64) / F.col("n")
    place = F.row_number().over(Window.partitionBy("y").orderBy("o"))
    chosen = (slim.join(F.broadcast(sizes), "y").where(below).select("o", "y").distinct().withColumn("place", place)
              .where(F.col("place") <= share).drop("place"))
    # The sample is what is broadcast: max(``rows``, languages) rows of a number and a name.
    sample = (marked.join(F.broadcast(chosen), ["o", "y"]).groupBy("o", "y").agg(F.min("t").alias("t"))
              .repartition(1).sortWithinPartitions("o", "y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in W.pieces(batches, "t"):
            data, start, end, doc = _words(batch.column("t"))
            first = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            for i, y in enumerate(batch.column("y").to_pylist()):
                if first[i + 1] > first[i]:
                    taken = stretches(int(first[i + 1] - first[i])) + first[i]
                    held.append((y, b"\n".join(data[start[a]:end[b]].tobytes() for a, b in taken.tolist())))
        if held:
            m = _learn(held, epochs, rate, l2)
            body = store.pack([m.weight.ravel(), m.transition.ravel(), m.lexicon["word"], m.lexicon["langs"]])
            yield pa.RecordBatch.from_arrays([pa.array(["\x00".join(m.langs)]), pa.array([body], pa.binary())], ["langs", "body"])

    found = sample.mapInArrow(run, "langs string, body binary").collect()  # one row: 2^18 weights per language
    if not found:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros((0, 0)), {"word": np.zeros(0, U64), "langs": np.zeros(0, U64)})
    langs = found[0].langs.split("\x00")
    w, t, words, sets = store.unpack(found[0].body)
    return Model(langs, w.reshape(-1, len(langs)), t.reshape(len(langs), len(langs)), {"word": words, "langs": sets})


def label(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``lang_pred``, ``score`` (mean probability of that language over the words) and ``runs``.

    ``runs``: array of (start, length, lang), the stretches of words of one language.
    """
    kept = [c for c in docs.columns if c not in OUTPUTS]
    run_type = "array<struct<start:int,length:int,lang:string>>"
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema]
                       + ["lang_pred string", "score double", f"runs {run_type}"])
    item = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("lang", pa.string())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        langs = pa.array([*own.langs, UNDETERMINED])
        for batch in W.pieces(batches, "__low"):
            n = batch.num_rows
            data, start, end, doc = _words(batch.column("__low"))
            usable = np.asarray(batch.column("__letter").fill_null(False)) & (len(own.langs) > 0)
            on = usable[doc]
            start, end, doc = start[on], end[on], doc[on]
            best, score = np.full(n, len(own.langs)), np.zeros(n)
            heads, length, tongue = (np.zeros(0, np.int64) for _ in range(3))
            if len(doc):
                texts, size = np.unique(doc, return_counts=True)
                p = marginals(own.emissions(data, start, end), size, own.transition)
                first = np.cumsum(size) - size
                mean = np.add.reduceat(p, first, axis=0) / size[:, None]
                best[texts], score[texts] = mean.argmax(1), mean.max(1)
                lang = p.argmax(1)
                turn = np.ones(len(doc), bool)
                turn[1:] = (doc[1:] != doc[:-1]) | (lang[1:] != lang[:-1])
                heads = np.flatnonzero(turn)
                length = np.diff(np.append(heads, len(doc)))
                tongue = lang[heads]
            rows = pa.StructArray.from_arrays(
                [pa.array((heads - np.searchsorted(doc, doc[heads])).astype(np.int32)), pa.array(length.astype(np.int32)), langs.take(pa.array(tongue))],
                fields=list(item))
            edge = np.searchsorted(doc[heads], np.arange(n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], langs.take(pa.array(best)), pa.array(np.minimum(score, 1.0)),
                                              pa.ListArray.from_arrays(pa.array(edge), rows)], [*kept, *OUTPUTS])

    low = F.lower(F.col(text).cast("string"))
    return docs.select(*kept, low.alias("__low"), low.rlike(r"\p{L}").alias("__letter")).mapInArrow(run, schema)
