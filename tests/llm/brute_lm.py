"""The language model of lmscore in plain Python: dictionaries of words and contexts, loops over texts, words and bits.

It takes from the operator the tree of codes and the regression, which it feeds event by event.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from brute import SPACED, lower

from tidemark.llm import lmscore as L
from tidemark.llm.textcore import word_hashes


def name_of(word: bytes | None) -> int:
    if word is None:
        return 0
    raw = np.concatenate([np.frombuffer(word, np.uint8), np.zeros(8, np.uint8)])
    return int(word_hashes(raw, np.array([0]), np.array([len(word)]))[0])


def logit(one: float, zero: float) -> float:
    return math.log((one + 0.4) / (zero + 0.4))


def gate_of(n: float) -> int:
    return sum(n >= b for b in L.SEEN)


def byte_contexts(word: bytes) -> list[tuple[int, int]]:
    out, past = [], [0, 0, 0]
    for b in [*word, 32]:
        out.append((past[0] * 64 + (past[1] * 167 >> 3) % 16 * 4 + (past[2] * 59 >> 5) % 4, b))
        past = [b, *past[:2]]
    return out


def byte_path(b: int) -> list[tuple[int, int]]:
    node, out = 0, []
    for shift in range(7, -1, -1):
        bit = b >> shift & 1
        out.append((node, bit))
        node = 2 * node + 1 + bit
    return out


class Tables:
    """Counts of bits by (context, node) at three widths, and the weights that all events teach."""

    def __init__(self, events, narrow, base):
        self.narrow, self.base = narrow, base
        self.count = [defaultdict(lambda: [0, 0]) for _ in range(3)]
        for c, node, bit in events:
            for k, x in enumerate(narrow(c)):
                self.count[k][x, node][bit] += 1
        xs, bits, gates = [], [], []
        for c, node, bit in events:
            x = self.inputs(c, node, bit)
            xs.append(x[0])
            bits.append(bit)
            gates.append(x[1])
        x = np.array(xs, np.float32).reshape(-1, 3)
        self.weights = L.learned(x, np.array(bits, bool), np.ones(len(x), np.float32), np.array(gates, int))

    def inputs(self, c, node, without=None):
        out, seen = [], 0
        for k, x in enumerate(self.narrow(c)):
            n = list(self.count[k].get((x, node), (0, 0)))
            if without is not None:
                n[without] -= 1
            out.append(float(np.float16(logit(n[1], n[0]))) if without is None else logit(n[1], n[0]))
            seen = sum(n)
        if self.base is not None:
            out[0] = self.base(node)
        return out, gate_of(seen)


def scores(docs, head=L.HEAD):
    """docs: (doc_id, text). -> log10 probabilities in order."""
    texts = [[w.encode() for w in SPACED.findall(lower(t or ""))] + [None] for _, t in docs]
    learn = [d is not None and zlib.crc32(str(d).encode()) % 7 != 2 for d, _ in docs]
    names = {w: name_of(w) for t in texts for w in t}
    count = Counter(w for t, own in zip(texts, learn, strict=True) for w in t if own)
    level = {w: int(math.floor(math.log2(c) * 16)) for w, c in count.items()}
    least, held = 1 << 20, 0
    for lv, n in sorted(Counter(level.values()).items(), reverse=True):
        if held + n > head or lv < L.RARE:
            break
        least, held = lv, held + n
    top = [w for w in count if level[w] >= least]
    total, known = sum(count.values()), sum(count[w] for w in top)
    codes = L.Codes(np.array([names[w] for w in top], np.uint64), np.array([count[w] for w in top]), total - known)
    at = {int(x): i for i, x in enumerate(codes.name)}
    sym = {w: at.get(names[w], len(codes.name)) for w in names}

    def contexts(text):
        one = two = L.CLASSES - 2
        for w in text:
            yield one * L.SECOND + two % L.SECOND
            one, two = int(codes.cls[sym[w]]), one

    def path(w):
        e = codes.exit[sym[w]]
        return [(int(codes.node[i]), int(codes.bit[i])) for i in range(codes.off[e], codes.off[e + 1])]

    word_events = [(c, n, b) for t, own in zip(texts, learn, strict=True) if own for c, w in zip(contexts(t), t, strict=True) for n, b in path(w)]
    far = [w for t, own in zip(texts, learn, strict=True) if own for w in t if sym[w] == len(codes.name)]
    byte_events = [(c, n, b) for w in far for c, x in byte_contexts(w) for n, b in byte_path(x)]
    tree = Tables(word_events, lambda c: (0, c // L.SECOND, c), lambda n: float(codes.logit[n]))
    spell = Tables(byte_events, lambda c: (c // 64, c // 4, c), None)

    def spelled(w):
        bits = 0.0
        for c, x in byte_contexts(w):
            cost = 0.0
            for n, b in byte_path(x):
                v, gate = spell.inputs(c, n)
                z = min(max(float(np.dot(spell.weights[gate], v)), -14), 14)
                cost += math.log1p(math.exp(-z if b else z)) / math.log(2)
            bits += round(cost * 256) / 256
        return bits

    follow = defaultdict(Counter)
    for t, own in zip(texts, learn, strict=True):
        past = [L.START, L.START]
        for w in t:
            if own:
                follow[past[0], past[1]][w] += 1
            past = [w, past[0]]
    once = sum(c == 1 for c in count.values())
    beyond = total - known
    new = (once + 0.5) / (beyond + 1)
    check = lambda w: names[w] >> 40 & 0xFFFF
    out = []
    for t, own in zip(texts, learn, strict=True):
        bits, past, guesses = 0.0, [L.START, L.START], []
        g = [float(x) for x in L.GUESS]
        weights = tree.weights.astype(np.float32).astype(float).copy()
        step, g_seen, t_seen = 0, [], []

        def refine():
            if g_seen:
                scale = L.RATE / math.sqrt(len(g_seen) + 16)
                for j in range(3):
                    g[j] += scale * sum(e * x[j] for e, x in g_seen)
            for gate in range(len(weights)):
                mine = [(e, x) for k, e, x in t_seen if k == gate]
                for j in range(3):
                    weights[gate, j] += L.RATE / math.sqrt(len(mine) + 16) * sum(e * x[j] for e, x in mine)
            g_seen.clear()
            t_seen.clear()

        for place, (c, w) in enumerate(zip(contexts(t), t, strict=True)):
            now = sum(place >= b for b in (16, 32, 64, 128, 256, 512)) if place < 512 else 5 + place // 512
            if now != step:
                refine()
                step = now
            have = Counter(follow[past[0], past[1]])
            past = [w, past[0]]
            if own:
                have[w] -= 1
            have = {k: v for k, v in have.items() if v > 0}
            if have:
                best = min(have, key=lambda k: (-have[k], check(k)))
                n, m = sum(have.values()), have[best]
                opinion = lambda part: logit(sum(part), len(part) - sum(part))
                x = [float(L.GUESS_LOGIT[int(L.guess_gate(np.array(n), np.array(m)))]), opinion(guesses), opinion(guesses[-L.LATE :])]
                right = best == w
                z = min(max(sum(a * b for a, b in zip(g, x, strict=True)), -14), 14)
                bits += math.log1p(math.exp(-z if right else z)) / math.log(2)
                g_seen.append((right - 1 / (1 + math.exp(-z)), x))
                guesses.append(int(right))
                if right:
                    continue
            for n, b in path(w):
                x, gate = tree.inputs(c, n)
                z = min(max(float(np.dot(weights[gate], x)), -14), 14)
                bits += math.log1p(math.exp(-z if b else z)) / math.log(2)
                t_seen.append((gate, b - 1 / (1 + math.exp(-z)), x))
            bits += float(codes.below[sym[w]])
            if sym[w] == len(codes.name):
                k = count[w] - own
                bits += -math.log2((1 - new) * k / max(beyond, 1)) if k > 0 else -math.log2(new) + spelled(w)
        out.append(-bits * math.log10(2))
    return out
