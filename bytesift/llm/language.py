"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time. A text's UTF-8 bytes are cut into
windows of ``SPAN``; two gated recurrent layers read each window forwards and backwards, every position
gets a probability of each language, and a document's probabilities are the means over its positions.
Arrays have features as rows and windows as columns, so a time step is a few calls over many windows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytesift.llm.common import crc_bucket_col, with_fields
from bytesift.storage import materialise, release

SPAN, HIDDEN, PAD = 64, 8, 256
#: Windows that go through the network at once.
WIDE = 4096
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    """Numerals such as a half or a Roman eight are no letters."""
    return any(map(str.isalpha, text))


@dataclass
class Net:
    """For each direction: table (3H x 257, the input's share of the gates r, z, n), u (3H x H), bias (H x 1) of the candidate's recurrent share."""

    langs: list[str]
    table: list[np.ndarray]
    u: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    shift: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [*self.table, *self.u, *self.bias, self.out, self.shift]


def new_net(langs: list[str], seed: int, hidden: int = HIDDEN) -> Net:
    rng = np.random.default_rng(seed)
    f = lambda *s, by=0.3: (rng.standard_normal(s) * by).astype(np.float32)
    two = range(2)
    return Net(langs, [f(3 * hidden, 257) for _ in two], [f(3 * hidden, hidden) for _ in two], [f(hidden, 1) for _ in two], f(len(langs), 2 * hidden), f(len(langs), 1, by=0.01))


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(windows x SPAN bytes, the text of each window); the last window of a text is padded."""
    counts = np.array([-(-len(t) // SPAN) for t in texts], dtype=np.int64)
    rows = np.full((int(counts.sum()), SPAN), PAD, dtype=np.int16)
    flat, at = rows.reshape(-1), 0
    for t, n in zip(texts, counts.tolist(), strict=True):
        flat[at : at + len(t)] = np.frombuffer(t, dtype=np.uint8)
        at += n * SPAN
    return rows, np.repeat(np.arange(len(texts)), counts)


def _squash(a: np.ndarray) -> np.ndarray:
    """a / (1 + |a|) in place: stands for tanh at a fifth of its cost, in training too. Its slope is (1 - |result|) squared."""
    below = np.abs(a)
    below += 1
    a /= below
    return a


def _layer(table, u, bias, x, order, keep=None) -> np.ndarray:
    """Hidden states (SPAN x H x windows); ``x`` is SPAN x windows. ``keep`` gets what the way back needs."""
    h3, n = u.shape[0], x.shape[1]
    hid = h3 // 3
    states = np.empty((len(x), hid, n), dtype=np.float32)
    h = np.zeros((hid, n), dtype=np.float32)
    for t in order:
        a = np.take(table, x[t], axis=1, mode="clip")  # indices are in range: clip only spares the check
        rec = u @ h
        rz = a[: 2 * hid]
        rz += rec[: 2 * hid]
        _squash(rz)
        rz *= 0.5
        rz += 0.5
        un = rec[2 * hid :]
        un += bias
        cand = a[2 * hid :]
        cand += rz[:hid] * un
        _squash(cand)
        if keep is not None:
            keep[t] = (h, rz, un, cand)
        h = h - cand
        h *= rz[hid:]
        h += cand
        states[t] = h
    return states


def probabilities(net: Net, rows: np.ndarray) -> np.ndarray:
    """For each window, the sums over its positions of each language's probability (windows x languages)."""
    out = np.zeros((len(rows), len(net.langs)))
    steps = range(SPAN)
    for at in range(0, len(rows), WIDE):
        x = np.ascontiguousarray(rows[at : at + WIDE].T).astype(np.intp)
        ahead = _layer(net.table[0], net.u[0], net.bias[0], x, steps)
        back = _layer(net.table[1], net.u[1], net.bias[1], x, reversed(steps))
        hid = net.u[0].shape[1]
        total = np.zeros((len(net.langs), x.shape[1]), dtype=np.float32)
        for t in steps:
            p = net.out[:, :hid] @ ahead[t]
            p += net.out[:, hid:] @ back[t]
            p += net.shift
            np.clip(p, -30, 30, out=p)
            np.exp(p, out=p)
            w = (x[t] != PAD) / p.sum(axis=0)
            p *= w.astype(np.float32)
            total += p
        out[at : at + WIDE] = total.T
    return out


def gradients(net: Net, rows: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """(mean loss of a position, the gradient of each of ``net.parts()``)."""
    x = np.ascontiguousarray(rows.T).astype(np.intp)
    steps, hid = range(len(x)), net.u[0].shape[1]
    keeps = [{}, {}]
    states = [_layer(net.table[d], net.u[d], net.bias[d], x, steps if d == 0 else reversed(steps), keeps[d]) for d in (0, 1)]
    both = np.concatenate(states, axis=1)
    logits = np.einsum("kh,thn->tkn", net.out, both) + net.shift
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    mask = (x != PAD).astype(np.float32)[:, None, :]
    count = mask.sum()
    cols = np.arange(x.shape[1])
    loss = float(-(np.log(p[:, y, cols] + 1e-9) * mask[:, 0]).sum() / count)
    p[:, y, cols] -= 1
    p *= mask / count
    d_out, d_shift = np.einsum("tkn,thn->kh", p, both), p.sum(axis=(0, 2))[:, None]
    d_states = np.einsum("kh,tkn->thn", net.out, p)
    d_table, d_u, d_bias = [], [], []
    for d in (0, 1):
        u = net.u[d]
        gates = np.zeros((len(x), 3 * hid, x.shape[1]), dtype=np.float32)
        gu, gb = np.zeros_like(u), np.zeros_like(net.bias[d])
        carry = np.zeros((hid, x.shape[1]), dtype=np.float32)
        for t in reversed(steps) if d == 0 else steps:
            h, rz, un, cand = keeps[d][t]
            r, z = rz[:hid], rz[hid:]
            dh = d_states[t, d * hid : (d + 1) * hid] + carry
            dn = dh * (1 - z) * (1 - np.abs(cand)) ** 2
            dr = dn * un * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
            dz = dh * (h - cand) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
            dun = dn * r
            gates[t, :hid], gates[t, hid : 2 * hid], gates[t, 2 * hid :] = dr, dz, dn
            rec = np.concatenate([dr, dz, dun])
            gu += rec @ h.T
            gb += dun.sum(axis=1, keepdims=True)
            carry = dh * z + u.T @ rec
        flat = x.reshape(-1)
        d_table.append(np.stack([np.bincount(flat, weights=g.reshape(-1), minlength=257) for g in gates.transpose(1, 0, 2)]).astype(np.float32))
        d_u.append(gu)
        d_bias.append(gb)
    return loss, [*d_table, *d_u, *d_bias, d_out, d_shift]


def train(texts: list[str], langs: list[str], seed: int = 7, steps: int = 220, batch: int = 256, windows: int = 40_000, rate: float = 0.02) -> Net:
    """A net for the languages in ``langs``; each language has the same share of a batch."""
    names = sorted(set(langs))
    net = new_net(names, seed)
    rows, of = cut([t.encode() for t in texts])
    label = np.array([names.index(v) for v in langs], dtype=np.int64)[of] if len(of) else np.zeros(0, np.int64)
    rng = np.random.default_rng(seed)
    by = [np.flatnonzero(label == k) for k in range(len(names))]
    by = [rng.permutation(b)[: max(1, windows // len(names))] for b in by if len(b)]
    if len(names) < 2 or len(by) < 2:
        return net
    m, v = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()]
    for step in range(1, steps + 1):
        few = by if len(by) <= batch else [by[k] for k in rng.choice(len(by), batch, replace=False)]
        pick = np.concatenate([rng.choice(b, batch // len(few)) for b in few])
        _, grads = gradients(net, rows[pick], label[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        lr = rate * min(1, 2 * (1 - step / (steps + 1)))
        for p, g, a, b in zip(net.parts(), grads, m, v, strict=True):
            g = g * min(1, 1 / (norm + 1e-9))
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= (lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def training_rows(docs: DataFrame, text: str = "text", per_language: int = 250, most_rows: int = 10_000, longest: int = 20_000) -> tuple[list[str], list[str]]:
    """(texts, languages): of each language at most ``per_language`` rows, those whose ids hash lowest, and ``most_rows`` in all.

    With so many languages that their rows would be more than ``most_rows``, each gets fewer, one at least; only languages beyond
    the ``most_rows`` most frequent get none. Only rows with a language whose crc32(doc_id as text) mod 3 is not 1;
    empty texts and those over ``longest`` characters aren't learned from and take no other row's place; a
    row that repeats counts once. Two scans of ``docs``, whatever the number of languages.
    """
    t = F.length(text)
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (crc_bucket_col("doc_id", 3) != 1) & (t > 0) & (t <= longest))
    usable = usable.select("doc_id", "lang", F.xxhash64(text).alias("mark"), F.col(text).alias("t"))
    learnable = materialise(usable.select("doc_id", "lang", "mark", F.xxhash64("doc_id").alias("place")), "learnable")
    counts = learnable.groupBy("lang").agg(F.count("*").alias("n"))
    names = materialise(counts.orderBy(F.desc("n"), "lang").limit(most_rows), "languages")
    each = max(1, min(per_language, most_rows // max(1, names.count())))
    # the lowest hashes hold three times the rows that are wanted, so what is ranked is small
    share = F.least(F.lit(1.0), F.lit(3.0 * each + 100) / F.col("n"))
    low = learnable.join(names, "lang").where(F.col("place") <= (share * 2.0**64 - 2.0**63)).select("lang", "doc_id", "mark", "place").distinct()
    ranked = low.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id", "mark")))
    ids = ranked.where(F.col("rank") <= each).select("lang", "doc_id", "mark")
    rows = usable.join(F.broadcast(ids), ["lang", "doc_id", "mark"]).groupBy("lang", "doc_id", "mark").agg(F.min("t").alias("t")).collect()
    release(learnable)
    release(names)
    rows.sort(key=lambda r: (r["lang"], r["doc_id"], r["t"]))
    return [r["t"] for r in rows], [r["lang"] for r in rows]


def predict(docs: DataFrame, net: Net, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (the pooled probability of it) of every whole text.

    A null text or one without a letter: ``und`` with score 0; so are all if the net knows no language.
    Columns of these names are replaced, others pass through; repeated rows stay; an empty table: an
    empty result. lang, source and doc_id are never looked at.
    """
    held = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("lang_pred string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        n = held.value
        lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if t and has_letter(t)] if n.langs else []
        at = 0
        while at < len(known):
            part, size = [], 0
            while at < len(known) and size < 1 << 20:
                part.append(known[at])
                size += len(texts.iat[known[at]])
                at += 1
            rows, of_text = cut([texts.iat[i].encode() for i in part])
            sums = np.zeros((len(part), len(n.langs)))
            np.add.at(sums, of_text, probabilities(n, rows))
            sums /= sums.sum(axis=1, keepdims=True)
            best = sums.argmax(axis=1)
            for i, k, s in zip(part, best.tolist(), sums[np.arange(len(part)), best], strict=True):
                lang[i], score[i] = n.langs[k], min(1.0, float(s))
        return pd.DataFrame({"lang_pred": lang, "score": score})

    return with_fields(docs, of.asNondeterministic()(F.col(text)), {"lang_pred": None, "score": None})
