"""Language ID by a byte convolutional network.

Method.  A text's UTF-8 bytes are cut into windows of ``WINDOW`` bytes that
cover all of it.  Filters of widths 2, 3 and 4 run over embedded bytes, each
filter's largest activation in the window is kept, and a softmax layer gives
the languages' probabilities; a text's are the mean over its windows,
weighted by their lengths, so one foreign passage does not decide.  How sure
the windows are, the mean of each one's best probability, tells whether the
text is of known languages at all, one or several.  The network is trained in numpy on the
driver from a bounded sample: of every language the ``SAMPLE_DOCS`` training
documents with the smallest hash (one per hash bucket, chosen with map-side
aggregation), and of each ``SAMPLE_WINDOWS`` windows at hashed places of the
whole text, cut out in the tasks.  Prediction is
a map over Arrow batches of every text, whole; embedding and convolution of
a byte are folded into one table per filter position, so a filter's output is
a sum of table rows.

Only text and lang are learned from, only of documents outside the held-out
fold (crc32 of the id's digits divisible by 5).

Defined results: ``und`` with score 0 for null texts and texts without a
letter; repeated rows are predicted alike; an empty table gives an empty
result; without any labelled training text every prediction is ``und`` with
score 0; with one language that language has score 1.  Extra columns are
carried by ``with_language`` (its own start with ``__lid_``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .buffers import slices, text_buffer
from .stage import ship_package

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 16, 8
#: Bound of the training sample: documents per language, windows per document.
SAMPLE_DOCS, SAMPLE_WINDOWS = 512, 6
EPOCHS, BATCH, RATE, SEED = 6, 64, 0.004, 7
UNKNOWN = "und"
#: A text whose windows are less sure is of no language that the network knows.
MIN_SCORE = 0.4

_LETTER = regex.compile(r"\p{L}")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sample_windows(text: Column, mark: Column) -> Column:
    """``SAMPLE_WINDOWS`` byte windows of a text, anywhere in it: whole windows
    and, for short texts to come, snippets of any length."""
    raw = text.cast("binary")
    size = F.octet_length(raw)

    def window(k: int) -> Column:
        snippet = F.pmod(F.xxhash64(mark, F.lit(2 * k)), F.lit(WINDOW - 8)) + 8
        own = F.least(size, F.lit(WINDOW) if k % 2 == 0 else snippet.cast("int"))
        at = F.pmod(F.xxhash64(mark, F.lit(2 * k + 1)), (size - own + 1).cast("long"))
        return F.substring(raw, (at + 1).cast("int"), own)

    return F.array(*[window(k) for k in range(SAMPLE_WINDOWS)])


def training_sample(docs: DataFrame) -> list[tuple[str, list[bytes]]]:
    """(lang, byte windows) of at most ``SAMPLE_DOCS`` training documents a
    language, spread over hash buckets so that no task gathers a language."""
    train = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") > 0))
    mark = F.xxhash64("text")
    picked = (
        train.select("lang", "text", mark.alias("mark"))
        .groupBy("lang", F.pmod("mark", F.lit(SAMPLE_DOCS)).alias("bucket"))
        .agg(F.min(F.struct("mark", sample_windows(F.col("text"), F.col("mark")).alias("windows"))).alias("first"))
        .select("lang", "first.mark", "first.windows")
    )
    rows = picked.collect()
    return [(r["lang"], [bytes(w) for w in r["windows"]]) for r in sorted(rows, key=lambda r: (r["lang"], r["mark"]))]


class ByteCNN:
    """Embedding, multi-width convolution, max pooling, softmax."""

    def __init__(self, langs: list[str]) -> None:
        rng = np.random.default_rng(SEED)
        self.langs = langs
        n = FILTERS * len(WIDTHS)
        self.p = {"emb": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)
        self.p["out"] = rng.normal(0, n**-0.5, (n, len(langs))).astype(np.float32)
        self.p["bias"] = np.zeros(len(langs), np.float32)

    def train(self, windows: np.ndarray, labels: np.ndarray) -> None:
        """Adam over shuffled batches of byte windows (padded with zeros)."""
        rng = np.random.default_rng(SEED)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(windows))
            for a in range(0, len(order), BATCH):
                at = order[a : a + BATCH]
                grads = self._gradients(windows[at], labels[at])
                step += 1
                for k, g in grads.items():
                    m[k] += 0.1 * (g - m[k])
                    v2[k] += 0.001 * (g * g - v2[k])
                    rate = RATE * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
                    self.p[k] -= (rate * m[k] / (np.sqrt(v2[k]) + 1e-8)).astype(np.float32)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(x)
        e = p["emb"][x]
        cols, tops, pooled = {}, {}, []
        for w in WIDTHS:
            c = np.concatenate([e[:, i : x.shape[1] - w + 1 + i] for i in range(w)], 2)
            z = c @ p[f"w{w}"] + p[f"b{w}"]
            top = z.argmax(1)
            cols[w], tops[w] = c, top
            pooled.append(np.maximum(np.take_along_axis(z, top[:, None], 1)[:, 0], 0))
        h = np.concatenate(pooled, 1)
        logits = h @ p["out"] + p["bias"]
        d = np.exp(logits - logits.max(1, keepdims=True))
        d /= d.sum(1, keepdims=True)
        d[np.arange(n), y] -= 1
        d /= n
        grads = {"out": h.T @ d, "bias": d.sum(0), "emb": np.zeros_like(p["emb"])}
        dh = (d @ p["out"].T) * (h > 0)
        rows = np.arange(n)[:, None]
        for k, w in enumerate(WIDTHS):
            g = dh[:, k * FILTERS : (k + 1) * FILTERS]
            at = cols[w][rows, tops[w]]  # (n, filters, w * embed): only each filter's best place learns
            grads[f"w{w}"] = np.einsum("nf,nfc->cf", g, at)
            grads[f"b{w}"] = g.sum(0)
            back = (g[:, :, None] * p[f"w{w}"].T[None]).reshape(n, FILTERS, w, EMBED)
            for i in range(w):
                np.add.at(grads["emb"], x[rows, tops[w] + i], back[:, :, i])
        return grads

    def tables(self) -> dict[int, np.ndarray]:
        """Per width one table (width, 256, filters): a byte's share of each
        filter's output at that position."""
        return {w: np.stack([self.p["emb"] @ self.p[f"w{w}"][i * EMBED : (i + 1) * EMBED] for i in range(w)]) for w in WIDTHS}


class Predictor:
    """The trained network folded into tables of byte pairs."""

    def __init__(self, net: ByteCNN) -> None:
        t = net.tables()
        pair = lambda w, i: (t[w][i][:, None] + t[w][i + 1][None]).reshape(65536, FILTERS)
        # Width 2: one pair; width 3: a pair and a byte; width 4: two pairs.
        self.p2 = np.ascontiguousarray(pair(2, 0))
        self.p3, self.s3 = np.ascontiguousarray(pair(3, 0)), np.ascontiguousarray(t[3][2])
        self.p4a, self.p4b = np.ascontiguousarray(pair(4, 0)), np.ascontiguousarray(pair(4, 2))
        self.bias = np.concatenate([net.p[f"b{w}"] for w in WIDTHS])
        self.out, self.out_bias, self.langs = net.p["out"], net.p["bias"], net.langs

    def logits(self, windows: np.ndarray) -> np.ndarray:
        pairs = windows[:, :-1].astype(np.int32) << 8 | windows[:, 1:]
        z2 = self.p2[pairs].max(1)
        z = self.p3[pairs[:, :-1]]
        z += self.s3[windows[:, 2:]]
        z3 = z.max(1)
        z = self.p4a[pairs[:, :-2]]
        z += self.p4b[pairs[:, 2:]]
        z4 = z.max(1)
        h = np.maximum(np.concatenate([z2, z3, z4], 1) + self.bias, 0)
        return h @ self.out + self.out_bias

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of every text (at least one byte) from all its windows,
        and how sure these are: the mean of their best probabilities."""
        sizes = np.diff(offsets)
        per = -(-sizes // WINDOW)
        first = np.cumsum(per) - per
        row = np.repeat(np.arange(len(sizes)), per)
        within = (np.arange(len(row)) - first[row]) * WINDOW
        length = np.minimum(sizes[row] - within, WINDOW)
        total, sure = np.zeros((len(sizes), len(self.langs))), np.zeros(len(sizes))
        padded = np.r_[data, np.zeros(WINDOW, np.uint8)]
        span = np.arange(WINDOW)
        for a in range(0, len(row), 512):
            b = slice(a, a + 512)
            w = padded[(offsets[:-1][row[b]] + within[b])[:, None] + span]
            w[span[None] >= length[b, None]] = 0
            z = self.logits(w)
            z = np.exp(z - z.max(1, keepdims=True))
            z = z / z.sum(1, keepdims=True) * length[b, None]
            np.add.at(total, row[b], z)
            np.add.at(sure, row[b], z.max(1))
        return total / sizes[:, None], sure / sizes


def train_network(rows: list[tuple[str, list[bytes]]]) -> Predictor | None:
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return None
    windows, labels = [], []
    for lang, parts in rows:
        for raw in parts:
            w = np.zeros(WINDOW, np.uint8)
            w[: len(raw)] = np.frombuffer(raw, np.uint8)
            windows.append(w)
            labels.append(langs.index(lang))
    net = ByteCNN(langs)
    net.train(np.stack(windows), np.array(labels))
    return Predictor(net)


def with_language(docs: DataFrame, text_col: str = "text", predictor: Predictor | None = None) -> DataFrame:
    """``docs`` with ``__lid_pred``, ``__lid_score`` (the mean probability of
    that language) and ``__lid_sure`` (the mean of each window's best
    probability, of whatever language); without a predictor the network is trained on ``docs`` (doc_id, text, lang)."""
    if predictor is None:
        predictor = train_network(training_sample(docs))
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(predictor)
    schema = docs.schema
    schema = type(schema)(list(schema.fields)).add("__lid_pred", "string").add("__lid_score", "double").add("__lid_sure", "double")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(text_col))
            data, offsets = text_buffer(col)
            lang, score, sure = [UNKNOWN] * len(col), np.zeros(len(col)), np.zeros(len(col))
            for a, b in slices(offsets) if net is not None else ():
                texts = col.slice(a, b - a).to_pylist()
                known = np.flatnonzero([bool(t) and _LETTER.search(t) is not None for t in texts])
                sizes = np.diff(offsets[a : b + 1])[known]
                if not len(known):
                    continue
                part = np.concatenate([data[offsets[a + i] : offsets[a + i + 1]] for i in known])
                p, sure[a + known] = net.scores(part, np.r_[0, np.cumsum(sizes)])
                best = p.argmax(1)
                for i, k, s in zip(known, best, p.max(1), strict=True):
                    lang[a + i], score[a + i] = net.langs[k], s
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(sure)],
                names=[*batch.schema.names, "__lid_pred", "__lid_score", "__lid_sure"],
            )

    return docs.mapInArrow(work, schema)


def predict_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    predictor = train_network(training_sample(docs))
    out = with_language(docs.select("doc_id", "text"), predictor=predictor) if predictor else (
        docs.select("doc_id", F.lit(UNKNOWN).alias("__lid_pred"), F.lit(0.0).alias("__lid_score")))
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__lid_pred").alias("lang_pred"),
        F.col("__lid_score").alias("score"),
    )


def known_language(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang and any others) whose language
    is known: not ``und``, nor with windows less sure than ``MIN_SCORE``; a text
in several known languages stays, however even their parts.  Without any
    labelled text to learn from no language can be rejected: all rows with a
    letter stay."""
    predictor = train_network(training_sample(docs.select("doc_id", "text", "lang")))
    if predictor is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    marked = with_language(docs, predictor=predictor)
    return marked.filter((F.col("__lid_pred") != UNKNOWN) & (F.col("__lid_sure") >= MIN_SCORE)).select(*docs.columns)
