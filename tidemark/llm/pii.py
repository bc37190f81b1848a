"""Personal data: exact base patterns, and a character-level BiLSTM with CRF transitions on top.

The tagger is trained in numpy, in one task, on windows around labelled spans of a bounded sample. Long
texts are covered by windows of ``span`` characters that overlap by ``lap``; where two disagree, a character
takes the tag of the window whose edge is farther away, and spans are read off the whole reconciled tag
sequence. All windows are run: a disguised address (``anna (at) mail.example.com``) need hold neither a digit nor an ``@``.
"""

from __future__ import annotations

import hashlib
import re
import sys
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_rows, table

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TELL = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Matches of the e-mail pattern, found from each ``@`` outwards: linear in the text, however long its runs of letters."""
    out, last = [], 0
    for m in AT.finditer(text) if "@" in text else ():
        start = m.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            out.append(("email", start, m.end()))
            last = m.end()
    return out


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns by start, then kind as listed; offsets are code points, ends exclusive."""
    if not TELL.search(text):
        return []
    out = emails(text)
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return in_order(out)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


# --- the tagger ---------------------------------------------------------------------------------------

TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
CHARS = 131  # 0: padding; 1 to 128: ASCII; 129: other letters; 130: the rest
FORBIDDEN = -1e4
#: Windows that take their steps together, steps of them whose bounds are worked out together, and the padding that a text ends with, as in the windows that were learned from.
RUN_WINDOWS, BOUND_STEPS, END = 1024, 4, np.zeros(16, dtype=np.uint8)
TELLS = np.array([i > 0 and TELL.match(chr(i - 1)) is not None for i in range(CHARS)])


@dataclass(frozen=True)
class Settings:
    """``sample_docs``: so many documents at most are searched for labelled spans, ``sample_windows`` windows at most are learned from.

    Learning takes windows of ``window`` characters, ``stride`` apart; texts are decoded in windows of ``span`` that
    overlap by ``lap``. Of windows without a label, a digit and an ``@``, which are nearly all, one in ``plain`` may
    be learned from.
    """

    hidden: int = 16
    window: int = 96
    stride: int = 48
    span: int = 256
    lap: int = 32
    epochs: int = 12
    rate: float = 0.02
    batch: int = 32
    sample_docs: int = 20_000
    sample_windows: int = 2400
    plain: int = 64


@lru_cache(maxsize=1)
def _known() -> np.ndarray:
    """The numbers of all code points; CHARS for those that no text has held yet."""
    out = np.full(sys.maxunicode + 1, CHARS, dtype=np.uint8)
    out[:128] = np.arange(1, 129)
    return out


def codes(text: str) -> np.ndarray:
    """A number below CHARS for each character."""
    if text.isascii():
        return np.frombuffer(text.encode("ascii"), dtype=np.uint8) + np.uint8(1)
    points, known = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), _known()
    out = known[points]
    new = out == CHARS
    if new.any():
        kinds = np.unique(points[new])
        known[kinds] = [129 if chr(c).isalpha() else 130 for c in kinds]
        out = known[points]
    return out


def tags_of(n: int, spans: list[Span]) -> np.ndarray:
    out = np.zeros(n, dtype=np.int64)
    for kind, start, end in spans:
        if not out[start:end].any():
            k = KINDS.index(kind)
            out[start:end] = 2 + 2 * k
            out[start] = 1 + 2 * k
    return out


def spans_of(tags: np.ndarray) -> list[Span]:
    """Maximal runs of a begin tag and the inside tags of its kind; an inside tag without a begin starts a span too."""
    out, start, kind = [], -1, -1
    marked = np.flatnonzero(tags)
    for i in marked:
        k, begins = divmod(int(tags[i]) - 1, 2)
        if start >= 0 and i == end and k == kind and begins == 1:
            end = i + 1
            continue
        if start >= 0:
            out.append((KINDS[kind], int(start), int(end)))
        start, end, kind = i, i + 1, k
    if start >= 0:
        out.append((KINDS[kind], int(start), int(end)))
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


class Tagger:
    """Embedding folded into the input weights, an LSTM each way, a linear layer, CRF transitions; Adam updates."""

    def __init__(self, hidden: int, seed: int = 7):
        rng, h = np.random.default_rng(seed), hidden
        self.h = h
        self.p = {f"{k}{d}": v for d in "fb" for k, v in (("x", rng.normal(0, 0.3, (CHARS, 4 * h))), ("u", rng.normal(0, 0.5 / np.sqrt(h), (h, 4 * h))), ("c", np.concatenate([np.ones(h), np.zeros(3 * h)])))}
        self.p |= {"o": rng.normal(0, 0.5 / np.sqrt(2 * h), (2 * h, TAGS)), "ob": np.zeros(TAGS), "t": np.zeros((TAGS, TAGS)), "s": np.zeros(TAGS)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.bar = np.zeros((TAGS, TAGS), dtype=np.float32)  # an inside tag follows a tag of its kind only
        for k in range(len(KINDS)):
            self.bar[:, 2 + 2 * k] = FORBIDDEN
            self.bar[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
        self.m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        self.t = 0

    def _run(self, x: np.ndarray, d: str, keep: bool):
        n, length = x.shape
        h = self.h
        table, u = self.p[f"x{d}"] + self.p[f"c{d}"], self.p[f"u{d}"]
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out, kept = np.empty((length, n, h), np.float32), []
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            a = table[x[:, t]] + state @ u
            g = sigmoid(a[:, : 3 * h])
            c = np.tanh(a[:, 3 * h :])
            fore, ins, outs = g[:, :h], g[:, h : 2 * h], g[:, 2 * h :]
            before, prior = cell, state
            cell = fore * cell + ins * c
            tc = np.tanh(cell)
            state = outs * tc
            out[t] = state
            if keep:
                kept.append((t, g, c, before, prior, tc))
        return out, kept

    def scores(self, x: np.ndarray, keep: bool = False):
        hf, kf = self._run(x, "f", keep)
        hb, kb = self._run(x, "b", keep)
        both = np.concatenate([hf, hb], axis=2)
        return both @ self.p["o"] + self.p["ob"], both, kf, kb

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        return self._paths(self.scores(x)[0], np.full(len(x), x.shape[1]))

    def _paths(self, e: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The best tags of each row's first ``sizes`` characters, given the scores of tags; outside behind them."""
        length, n, _ = e.shape
        move = self.p["t"] + self.bar
        best, back = e[0] + self.p["s"], np.empty((length, n, TAGS), np.int8)
        for t in range(1, length):
            all_ = best[:, :, None] + move
            on = (t < sizes)[:, None]
            back[t] = np.where(on, all_.argmax(axis=1), np.arange(TAGS))
            best = np.where(on, all_.max(axis=1) + e[t], best)
        out = np.empty((n, length), np.int64)
        out[:, -1] = best.argmax(axis=1)
        for t in range(length - 1, 0, -1):
            out[:, t - 1] = back[t][np.arange(n), out[:, t]]
        out[np.arange(length) >= sizes[:, None]] = 0
        return out

    def _states(self, x: np.ndarray, sizes: np.ndarray, onto: np.ndarray | None = None) -> np.ndarray:
        """The states that _run gives for each row's own characters alone, one array for each way; rows come in falling order of size.

        With ``onto``, a matrix for each way, only what they make of the states is kept: by way, step, matrix row and row of x.

        A sigmoid is 1 / (1 + exp(-v)) and a tanh is 2 / (1 + exp(-2 v)) - 1, the signs and the inner 2 put into the weights:
        exp takes half the time of tanh where numpy has no AVX-512. Where exp overflows, the quotients are the limits 0 and -1.
        Rows that have ended take no more steps.
        """
        n, length = x.shape
        h = self.h
        sign = np.repeat(np.array([-1.0, -1.0, -1.0, -2.0], np.float32), h)
        table = np.stack([((self.p[f"x{d}"] + self.p[f"c{d}"]) * sign).reshape(CHARS, 4, h) for d in "fb"]).transpose(2, 0, 1, 3).reshape(8 * CHARS, h)
        u = np.stack([(self.p[f"u{d}"] * sign).reshape(h, 4, h) for d in "fb"]).transpose(2, 0, 1, 3).copy()
        at = np.arange(length)[:, None]
        columns = np.stack([x.T, np.take_along_axis(x.T, np.maximum(sizes - 1 - at, 0), axis=0)], axis=1).astype(np.intp)
        place = (np.arange(8) * CHARS).reshape(4, 2, 1)  # where the table's rows of a gate and way begin
        still = len(sizes) - np.searchsorted(sizes[::-1], np.arange(length), side="right")  # rows with more than t characters
        whole = int(still[-1])
        out = (np.empty if whole == n else np.zeros)((2, length, n, h) if onto is None else (2, length, onto.shape[1], n), np.float32)
        state, cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        a, b, c = np.empty(8 * n * h, np.float32), np.empty(8 * n * h, np.float32), np.empty(2 * n * h, np.float32)
        k = 0
        with np.errstate(over="ignore"):
            for t in range(length):
                if k != still[t] or not t:
                    k = int(still[t])
                    if not k:
                        break
                    g, add, own = (v[: m * k * h].reshape(*shape, k, h) for v, m, shape in ((a, 8, (4, 2)), (b, 8, (4, 2)), (c, 2, (2,))))
                    fore, ins, outs, new = g
                    s, m, rows = state[:, :k], cell[:, :k], np.empty((4, 2, k), np.intp)
                np.add(columns[t, :, :k], place, out=rows)
                table.take(rows, axis=0, out=g, mode="clip")
                np.matmul(s, u, out=add)
                np.add(g, add, g)
                np.exp(g, g)
                np.add(g, 1.0, g)
                np.divide(2.0, new, own)
                np.subtract(own, 1.0, own)
                np.divide(own, ins, own)
                np.divide(m, fore, m)
                np.add(m, own, m)
                np.multiply(m, -2.0, s)
                np.exp(s, s)
                np.add(s, 1.0, s)
                np.divide(2.0, s, s)
                np.subtract(s, 1.0, s)
                np.divide(s, outs, s)
                if onto is None:
                    made, into = s, out
                else:
                    made, into = np.matmul(onto, s.transpose(0, 2, 1)).transpose(0, 2, 1), out.transpose(0, 1, 3, 2)
                into[0, t, :k] = made[0]
                into[1, length - 1 - t, :whole] = made[1, :whole]
                if k > whole:
                    into[1, sizes[whole:k] - 1 - t, np.arange(whole, k)] = made[1, whole:]
        return out

    def decode(self, x: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
        """The best tags of all windows. Windows whose all-outside path provably outweighs every other skip the search for the best path.

        ``sizes`` (in falling order) says how many characters of each row are text; all, if not given. RUN_WINDOWS rows
        take their steps together, and as many of those that need the search are searched together.
        """
        n, length = x.shape
        sizes = np.full(n, length) if sizes is None else sizes
        o, ob = self.p["o"], self.p["ob"]
        over = np.stack([(w[:, 1:] - w[:, :1]).T for w in (o[: self.h], o[self.h :])])  # how much any other tag gains on outside
        out, open_ = np.zeros((n, length), np.int8), [np.zeros(0, np.intp)]
        for k in range(0, n, RUN_WINDOWS):
            own = sizes[k : k + RUN_WINDOWS]
            open_.append(k + np.flatnonzero(self._may_leave(self._states(x[k : k + RUN_WINDOWS, : own[0]], own, over), own)))
        rows = np.concatenate(open_)
        for k in range(0, len(rows), RUN_WINDOWS):
            own = rows[k : k + RUN_WINDOWS]
            longest = int(sizes[own[0]])
            both = self._states(x[own, :longest], sizes[own])
            out[own, :longest] = self._paths(both[0] @ o[: self.h] + both[1] @ o[self.h :] + ob, sizes[own])
        return out

    def _may_leave(self, gains: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether some path of a row may outweigh the one that stays outside, given what other tags gain each way; rows come in falling order of size."""
        length, n = gains.shape[1], gains.shape[3]
        bias = (self.p["ob"][1:] - self.p["ob"][0])[:, None]
        # the most that the moves into, within and out of other tags gain
        move = self.p["t"] + self.bar
        move = move - move[0, 0]
        enter, start = move[0, 1:, None], (self.p["s"][1:] - self.p["s"][0])[:, None]
        opens = np.flatnonzero(enter > FORBIDDEN / 2)  # tags that may follow outside
        within, leave = move[1:, 1:].max(), max(0.0, float(move[1:, 0].max()))
        still = len(sizes) - np.searchsorted(sizes[::-1], np.arange(length), side="right")  # rows with more than t characters
        run = most = (gains[0, 0] + gains[1, 0] + bias + start).max(axis=0)
        most = most.copy()
        for at in range(1, length, BOUND_STEPS):
            gain = gains[0, at : at + BOUND_STEPS] + gains[1, at : at + BOUND_STEPS]
            gain += bias
            rest = gain.max(axis=1)
            rest += within
            gain += enter
            first = gain[:, opens].max(axis=1)
            for t, (go, new) in enumerate(zip(rest, first, strict=True), at):
                k = still[t]
                own, top = run[:k], most[:k]
                np.add(own, go[:k], own)
                np.maximum(own, new[:k], own)
                np.maximum(top, own, top)
        return ~(most + leave < -0.01)

    def learn(self, x: np.ndarray, y: np.ndarray, rate: float) -> float:
        e, both, kf, kb = self.scores(x, keep=True)
        length, n, _ = e.shape
        move = self.p["t"] + self.bar

        def lse(a, axis):
            top = a.max(axis=axis, keepdims=True)
            return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))

        alpha = np.empty_like(e)
        alpha[0] = e[0] + self.p["s"]
        for t in range(1, length):
            alpha[t] = lse(alpha[t - 1][:, :, None] + move, 1) + e[t]
        beta = np.zeros_like(e)
        for t in range(length - 2, -1, -1):
            beta[t] = lse(move + (beta[t + 1] + e[t + 1])[:, None, :], 2)
        whole = lse(alpha[-1], 1)
        rows, gold = np.arange(n), y.T
        de = np.exp(alpha + beta - whole[:, None])
        true = self.p["s"][gold[0]] + e[np.arange(length)[:, None], rows, gold].sum(axis=0) + move[gold[:-1], gold[1:]].sum(axis=0)
        g = {"t": np.zeros_like(self.p["t"]), "s": de[0].sum(axis=0)}
        g["t"] += np.exp(alpha[:-1, :, :, None] + move + (beta[1:] + e[1:] - whole[:, None])[:, :, None, :]).sum(axis=(0, 1))
        np.add.at(g["t"], (gold[:-1].ravel(), gold[1:].ravel()), -1.0)
        np.add.at(g["s"], gold[0], -1.0)
        de[np.arange(length)[:, None], rows, gold] -= 1.0
        de /= n
        g["t"] /= n
        g["s"] /= n
        flat = de.reshape(-1, TAGS)
        g["o"], g["ob"] = both.reshape(-1, 2 * self.h).T @ flat, flat.sum(axis=0)
        dh = de @ self.p["o"].T
        h = self.h
        for d, kept, dd in (("f", kf, dh[:, :, :h]), ("b", kb, dh[:, :, h:])):
            u = self.p[f"u{d}"]
            ds, dc, das = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), np.empty((length, n, 4 * h), np.float32)
            kept = kept[::-1]
            for da, (t, s, c, before, _, tc) in zip(das, kept, strict=True):
                ds = ds + dd[t]
                dc = dc + ds * s[:, 2 * h :] * (1 - tc * tc)
                da[:, : 3 * h] = np.concatenate([dc * before, dc * c, ds * tc], axis=1) * s * (1 - s)
                da[:, 3 * h :] = dc * s[:, h : 2 * h] * (1 - c * c)
                ds, dc = da @ u.T, dc * s[:, :h]
            flat = das.reshape(-1, 4 * h)
            gx = (np.arange(CHARS)[:, None] == x[:, [k[0] for k in kept]].T.ravel()).astype(np.float32) @ flat
            gu = np.concatenate([k[4] for k in kept]).T @ flat
            g[f"x{d}"], g[f"u{d}"], g[f"c{d}"] = gx, gu, gx.sum(axis=0)
        self.t += 1
        for k, v in g.items():
            v = np.clip(v, -1.0, 1.0)
            m, s = self.m[k]
            m += 0.1 * (v - m)
            s += 0.001 * (v * v - s)
            self.p[k] -= rate * (m / (1 - 0.9**self.t)) / (np.sqrt(s / (1 - 0.999**self.t)) + 1e-8)
        return float((whole - true).mean())

    def frozen(self) -> Tagger:
        self.m = {}
        return self


def windows(n: int, width: int, stride: int) -> range:
    """Starts of the overlapping windows that cover n characters."""
    return range(0, max(1, n - width + stride), stride)


def cut_windows(x: np.ndarray, width: int, stride: int) -> np.ndarray:
    """The windows over x, one a row, the last padded with zeros."""
    starts = windows(len(x), width, stride)
    padded = np.zeros(starts[-1] + width, dtype=x.dtype)
    padded[: len(x)] = x
    return np.lib.stride_tricks.sliding_window_view(padded, width)[::stride]


def reconciled(decoded: np.ndarray, n: int, stride: int) -> np.ndarray:
    """One tag for each of n characters: of the windows over it, the one whose edge is farther away has its say, the earlier one in a tie.

    Nothing lies before or behind the text, so its ends are no edges.
    """
    width = decoded.shape[1]
    at = np.arange(n, dtype=np.int64)
    last = np.minimum(at // stride, len(decoded) - 1)  # the window that began last
    before = np.maximum(last - 1, 0)
    inside = (before < last) & (at - before * stride < width)
    sooner = inside & (before * stride + width - 1 - at >= at - last * stride)
    use = np.where(sooner, before, last)
    return decoded[use, at - use * stride]


def tag(texts: list[str], model: Tagger, s: Settings) -> list[list[Span]]:
    """Spans of the tagger in whole texts. A character lies in at most two windows, so ``lap`` is at most half of ``span``."""
    stride = s.span - s.lap
    pieces = [cut_windows(np.append(codes(t), END), s.span, stride) if t else np.zeros((0, s.span), np.uint8) for t in texts]
    found: list[list[Span]] = [[] for _ in texts]
    counts = [len(p) for p in pieces]
    ends = np.cumsum([0, *counts])
    stacked = np.concatenate([np.zeros((0, s.span), np.uint8), *pieces])
    del pieces
    sizes = np.full(len(stacked), s.span)
    for end, count, text in zip(ends[1:], counts, texts, strict=True):
        if count:
            sizes[end - 1] = len(text) + len(END) - (count - 1) * stride
    # windows that repeat are decoded once: their characters tell their size
    _, first, again = np.unique(stacked.view(f"V{s.span}")[:, 0], return_index=True, return_inverse=True)
    first_of = np.argsort(-sizes[first], kind="stable")
    order = first[first_of]
    decoded = np.empty((len(order), s.span), np.int8)
    decoded[first_of] = model.decode(stacked[order], sizes[order])
    decoded = decoded[again]
    marked = decoded.any(axis=1)
    for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
        if marked[a:b].any():
            found[i] = spans_of(reconciled(decoded[a:b], len(texts[i]) + len(END), stride)[: len(texts[i])])
    return found


def merged(text: str, base: list[Span], more: list[Span]) -> list[Span]:
    """All base spans, and those of the tagger (trimmed of blanks, four characters at least) that overlap none of them."""
    out = list(base)
    for kind, start, end in more:
        while start < end and text[start].isspace():
            start += 1
        while end > start and text[end - 1].isspace():
            end -= 1
        if end - start >= 4 and all(end <= a or b <= start for _, a, b in base):
            out.append((kind, start, end))
    return in_order(out)


def disguised(text: str, spans: list[Span], rng: np.random.Generator) -> tuple[str, list[Span]]:
    """The text with some spans written as people write them to escape patterns, and the spans' new places."""
    out, new, last = [], [], 0
    for kind, start, end in spans:
        if start < last:
            continue
        own = text[start:end]
        if rng.random() < 0.5:
            if kind == "email":
                own = own.replace("@", rng.choice([" @ ", " (at) ", " [at] "]))
            elif kind == "phone":
                own = own.replace("+", "00", 1)
            elif kind == "card":
                own = rng.choice([".", "/"]).join(own[i : i + 4] for i in range(0, len(own), 4))
        out += [text[last:start], own]
        at = sum(map(len, out))
        new.append((kind, at - len(own), at))
        last = end
    return "".join([*out, text[last:]]), new


def fit(docs: DataFrame, s: Settings | None = None) -> Tagger:
    """Train on the base spans of a bounded sample of whole texts, half of them disguised. Without any span the tagger marks nothing."""
    s = s or Settings()
    share = min(1.0, s.sample_docs / max(1, docs.count()))
    chosen = docs.select("doc_id", "text").where(F.pmod(F.xxhash64("doc_id", F.lit("pii")), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))

    def cut():
        def batch(keys, texts):
            rows = []
            for key, text in zip(keys, texts, strict=True):
                spans = base_spans(text)
                rng = np.random.default_rng(abs(hash(key)) % (1 << 32))
                for copy, own in ((text, spans), disguised(text, spans, rng)) if spans else ((text, spans),):
                    x, y = codes(copy), tags_of(len(copy), own)
                    told, codes_, tags = (cut_windows(v, s.window, s.stride) for v in ((y > 0) | TELLS[x], x.astype(np.int64), y))
                    for piece, telling in zip(np.stack([codes_, tags], axis=1), told.any(axis=1), strict=True):
                        key = hashlib.md5(piece.tobytes()).digest()
                        if telling or int.from_bytes(key[-4:], "little") % s.plain == 0:
                            rows.append((piece[0], piece[1], key.hex()))
            return [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]

        return batch

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        import pickle

        model = Tagger(s.hidden)
        x, y = (np.stack([np.asarray(v) for v in pdf.sort_values("key")[c]]) for c in "xy")
        for epoch in range(s.epochs):
            order = np.random.default_rng(epoch).permutation(len(x))
            for k in range(0, len(x), s.batch):
                model.learn(x[order[k : k + s.batch]], y[order[k : k + s.batch]], s.rate * 0.85**epoch)
        return pd.DataFrame({"model": [pickle.dumps(model.frozen())]})

    cuts = map_rows(chosen.where("text <> ''"), ["doc_id", "text"], "x array<int>, y array<int>, key string", cut)
    few = cuts.orderBy("key").limit(s.sample_windows)  # the bound on what is learned from
    got = few.groupBy().applyInPandas(train, "model binary").collect()
    if not got:
        model = Tagger(s.hidden).frozen()
        model.p["ob"][0] = 1e3
        return model
    import pickle

    return pickle.loads(got[0]["model"])


def find(docs: DataFrame, model: Tagger, s: Settings | None = None) -> DataFrame:
    """doc_id, counts of the base spans by kind, base_sha256, spans (base and tagger's), text with null as empty.

    Rows that repeat give equal results; a table without rows gives none.
    """
    s = s or Settings()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def batch(keys, texts):
            texts = [t or "" for t in texts]
            base = [base_spans(t) for t in texts]
            every = [merged(t, b, m) for t, b, m in zip(texts, base, tag(texts, shared.value, s), strict=True)]
            counts = [[sum(x[0] == kind for x in b) for b in base] for kind in KINDS]
            return keys, *counts, [hashlib.sha256(written(b).encode()).hexdigest() for b in base], [written(x) for x in every]

        return batch

    return map_rows(docs, ["doc_id", "text"], "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", make)


def redact(docs: DataFrame, model: Tagger, s: Settings | None = None, column: str = "text") -> DataFrame:
    """The same rows and columns, every span of the text replaced by its kind in brackets; null texts stay null, rows that repeat stay, no rows give none."""
    s = s or Settings()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names, at = docs.columns, docs.columns.index(column)

    def make():
        def clean(text: str, spans: list[Span]) -> str:
            out, last = [], 0
            for kind, start, end in spans:
                if start >= last:
                    out += [text[last:start], f"[{kind}]"]
                last = max(last, end)
            return "".join([*out, text[last:]])

        def batch(*columns):
            columns = list(columns)
            texts = [t or "" for t in columns[at]]
            more = tag(texts, shared.value, s)
            columns[at] = [None if own is None else clean(t, merged(t, base_spans(t), m)) for own, t, m in zip(columns[at], texts, more, strict=True)]
            return columns

        return batch

    return map_rows(docs, names, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, fit(docs))
