"""A causal self-attention language model over subword ids, trained and applied in numpy.

A token is predicted from the tokens before it. The current and the previous token give a hidden vector directly, and
one attention layer adds what the KEYS tokens up to the current one say: queries, keys and values are vectors of the
token, and a bias by distance is added to their products. Windows of KEYS tokens overlap by half: the queries of a
window are its last STEP tokens, so that every token of a text is predicted exactly once and has STEP tokens of
context or more, as far as the text has them. The mask hides what comes after a query.

The output is a softmax over classes of ids and another over the members of the class, so that it costs the square
root of the vocabulary. Classes come from halving the ids again and again along the main direction of their
preceding tokens. Probabilities add up to one over all ids.
"""

from __future__ import annotations

import numpy as np

STEP, KEYS = 16, 32
#: Tokens of a window: its keys and the last target.
SPAN = KEYS + 1
#: Classes and members of a class; the ids of the vocabulary are class * WIDTH + member, and the beginning of a text
#: has the id beyond them.
WIDTH = 32
SIZE = WIDTH * WIDTH
BEGIN = SIZE
HEAD, HIDDEN, INNER = 8, 24, 16
#: Windows that go through the network together; their arrays fit into the cache.
CHUNK = 96
#: Logits are bounded, so that exponentials need no maximum.
TOP = np.float32(30)


def classes(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A place from 0 to SIZE - 1 for every id, from how often each id (column) follows another (row)."""
    share = np.log1p(pairs.T / (counts[:, None] + 1.0) * 1000).astype(np.float32)
    order = np.arange(len(counts))

    def halve(members: np.ndarray) -> np.ndarray:
        if len(members) <= 1:
            return members
        rows = share[members]
        rows = rows - rows.mean(axis=0)
        along = np.ones(rows.shape[1], np.float32)
        for _ in range(12):  # power iteration
            along = rows.T @ (rows @ along)
            along /= np.linalg.norm(along) + 1e-12
        place = np.argsort(rows @ along, kind="stable")
        middle = len(members) // 2
        return np.concatenate([halve(members[place[:middle]]), halve(members[place[middle:]])])

    out = np.empty(len(counts), np.int64)
    out[halve(order)] = order
    return out


class Network:
    NAMES = ("query", "key", "value", "now", "before", "distance", "mix", "bias", "group", "group_bias", "inner",
             "inner_of", "member", "member_bias")

    def __init__(self, counts: np.ndarray, seed: int = 5, pairs: np.ndarray | None = None):
        """``counts`` has the occurrences of every id; they are where the biases of the output start. With ``pairs``, how
        often each id (column) follows another (row), the logarithms of these odds are added to the logits."""
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        ids = SIZE + 1
        self.query, self.key, self.value = (normal(ids, HEAD, scale=0.3) for _ in range(3))
        self.now, self.before = normal(ids, HIDDEN, scale=0.3), normal(ids, HIDDEN, scale=0.15)
        self.distance = np.zeros(KEYS, np.float32)
        self.mix = normal(HEAD, HIDDEN, scale=0.3)
        self.bias = np.zeros(HIDDEN, np.float32)
        self.group = normal(HIDDEN, WIDTH, scale=0.1)
        self.inner, self.inner_of = normal(HIDDEN, INNER, scale=0.2), normal(WIDTH, INNER, scale=0.2)
        self.member = normal(INNER, WIDTH, scale=0.1)
        grid = counts.reshape(WIDTH, WIDTH) + 0.5
        self.group_bias = np.log(grid.sum(axis=1) / grid.sum()).astype(np.float32)
        self.member_bias = np.log(grid / grid.sum(axis=1, keepdims=True)).astype(np.float32)
        self.next_group = self.next_member = None
        if pairs is not None:
            # Witten-Bell: what was seen after an id, and as much of all ids as it has different followers.
            kinds = np.maximum((pairs > 0).sum(axis=1, keepdims=True), 1)
            odds = (pairs + kinds * (grid.ravel() / grid.sum())).reshape(ids, WIDTH, WIDTH)
            of_group = odds.sum(axis=2)
            self.next_group = np.log(of_group / of_group.sum(axis=1, keepdims=True)).astype(np.float32)
            self.next_member = np.log(odds / of_group[:, :, None]).astype(np.float32).reshape(-1, WIDTH)
            self.group_bias, self.member_bias = np.zeros_like(self.group_bias), np.zeros_like(self.member_bias)

    def parameters(self) -> list[np.ndarray]:
        return [getattr(self, n) for n in self.NAMES]

    def set(self, values: list[np.ndarray]) -> None:
        for n, v in zip(self.NAMES, values):
            setattr(self, n, v)

    def _mask(self) -> tuple[np.ndarray, np.ndarray]:
        """Distances of keys (columns) from queries (rows), and what is added to their products."""
        apart = (np.arange(STEP) + KEYS - STEP)[:, None] - np.arange(KEYS)[None]
        return apart, np.where(apart < 0, np.float32(-1e4), self.distance[np.maximum(apart, 0)])

    def _tables(self) -> list[np.ndarray]:
        """What is looked up together, side by side: by key, by the current id, and by class."""
        join = lambda *x: np.concatenate(x, axis=1)
        return [join(self.key, self.value), join(self.query, self.now + self.bias), join(self.inner_of, self.member_bias)]

    def _forward(self, windows: np.ndarray, tables: list[np.ndarray], kept: dict) -> dict:
        """The layers for some windows; ``g`` and ``m`` are exponentials of logits, ``picked`` the logits of the targets.

        The arrays are those in ``kept`` where they are there: fresh ones would cost as much as the arithmetic.
        """
        b, kind = len(windows), self.query.dtype
        r = b * STEP

        def new(name, *shape):
            if name not in kept or len(kept[name]) < shape[0]:
                kept[name] = np.empty(shape, kind)
            return kept[name][:shape[0]]

        def take(table, ids, name):
            return np.take(table, ids, axis=0, out=new(name, *ids.shape, table.shape[1]), mode="clip")

        by_key, by_now, by_group = tables
        w = windows.astype(np.int64)
        keys, now = np.ascontiguousarray(w[:, :KEYS]), np.ascontiguousarray(w[:, KEYS - STEP:KEYS])
        before, target = w[:, KEYS - STEP - 1:KEYS - 1].ravel(), w[:, KEYS - STEP + 1:].ravel()
        kv, qn = take(by_key, keys, "kv"), take(by_now, now, "qn")
        q, k, v = qn[:, :, :HEAD], kv[:, :, :HEAD], kv[:, :, HEAD:]
        a = np.matmul(q, k.transpose(0, 2, 1), out=new("a", b, STEP, KEYS))
        a += self._mask()[1]
        if a.max(initial=0) > TOP:
            np.minimum(a, TOP, out=a)
        np.exp(a, out=a)
        total = a.reshape(r, KEYS) @ np.ones(KEYS, kind)
        seen = np.matmul(a, v, out=new("seen", b, STEP, HEAD)).reshape(r, HEAD)
        seen /= total[:, None]
        now = now.ravel()
        h = np.matmul(seen, self.mix, out=new("h", r, HIDDEN))
        h += qn.reshape(r, -1)[:, HEAD:]
        h += take(self.before, before, "before")
        np.maximum(h, 0, out=h)
        group, member = target // WIDTH, target % WIDTH
        inner = np.matmul(h, self.inner, out=new("inner", r, INNER))
        of_group = take(by_group, group, "of_group")
        inner += of_group[:, :INNER]
        np.maximum(inner, 0, out=inner)
        g = np.matmul(h, self.group, out=new("g", r, WIDTH))
        m = np.matmul(inner, self.member, out=new("m", r, WIDTH))
        g += self.group_bias
        if self.next_group is not None:
            g += take(self.next_group, now, "next")
            m += take(self.next_member, now * WIDTH + group, "next")
        m += of_group[:, INNER:]
        wide = np.arange(r) * WIDTH
        at_group, at_member = wide + group, wide + member
        high = max(g.max(initial=0), m.max(initial=0)) >= TOP
        over = (g >= TOP, m >= TOP) if high else None
        for x in (g, m) if high else ():
            np.minimum(x, TOP, out=x)
        picked = g.ravel()[at_group] + m.ravel()[at_member]
        np.exp(g, out=g)
        np.exp(m, out=m)
        ones = np.ones(WIDTH, kind)
        return {"keys": keys, "now": now, "before": before, "q": q, "k": k, "v": v, "a": a, "total": total, "seen": seen,
                "h": h, "group": group, "inner": inner, "g": g, "m": m, "g_sum": g @ ones, "m_sum": m @ ones,
                "at_group": at_group, "at_member": at_member, "picked": picked, "over": over}

    def log10(self, windows: np.ndarray) -> np.ndarray:
        """(windows, STEP): the logarithm of each target's probability."""
        out, tables, kept = np.empty((len(windows), STEP), np.float32), self._tables(), {}
        for at in range(0, len(windows), CHUNK):
            f = self._forward(windows[at:at + CHUNK], tables, kept)
            logs = f["picked"] - np.log(f["g_sum"] * f["m_sum"])
            out[at:at + CHUNK] = (logs * np.float32(1 / np.log(10))).reshape(-1, STEP)
        return out

    def gradients(self, windows: np.ndarray, weight: np.ndarray, kept: dict | None = None) -> list[np.ndarray]:
        """Of the mean negative log-likelihood over the targets of weight 1; ``kept`` has arrays to be used again."""
        f = self._forward(windows, self._tables(), {} if kept is None else kept)
        n = len(windows)
        scale = (weight.ravel() / max(weight.sum(), 1)).astype(np.float32)
        d_g, d_m = f["g"], f["m"]
        for d, total, at in ((d_g, f["g_sum"], f["at_group"]), (d_m, f["m_sum"], f["at_member"])):
            d *= (scale / total)[:, None]
            d.ravel()[at] -= scale
        if f["over"]:
            d_g[f["over"][0]] = 0
            d_m[f["over"][1]] = 0
        ones = np.ones(n * STEP, d_g.dtype)
        d_inner = d_m @ self.member.T
        d_inner *= f["inner"] > 0
        d_h = d_g @ self.group.T
        d_h += d_inner @ self.inner.T
        d_h *= f["h"] > 0
        d_seen = d_h @ self.mix.T
        # What the weights of the keys pass on, less its mean under these weights.
        mean = np.einsum("ij,ij->i", d_seen, f["seen"])
        d_seen /= f["total"][:, None]
        mean /= f["total"]
        d_seen, a = d_seen.reshape(n, STEP, HEAD), f["a"]
        d_a = d_seen @ f["v"].transpose(0, 2, 1)
        d_a -= mean.reshape(n, STEP, 1)
        d_a *= a
        apart, _ = self._mask()
        d_distance = np.bincount(np.maximum(apart, 0).ravel(), (d_a.sum(axis=0) * (apart >= 0)).ravel(), KEYS)
        at_query = _add_rows(f["now"], [(d_a @ f["k"]).reshape(-1, HEAD), d_h], SIZE + 1)
        d_kv = np.empty((n, KEYS, 2 * HEAD), d_a.dtype)
        np.matmul(d_a.transpose(0, 2, 1), f["q"], out=d_kv[:, :, :HEAD])
        np.matmul(a.transpose(0, 2, 1), d_seen, out=d_kv[:, :, HEAD:])
        at_key = _add_rows(f["keys"].ravel(), [d_kv.reshape(-1, 2 * HEAD)], SIZE + 1)
        at_group = _add_rows(f["group"], [d_inner, d_m], WIDTH)
        return [
            at_query[:, :HEAD], at_key[:, :HEAD], at_key[:, HEAD:], at_query[:, HEAD:],
            _add_rows(f["before"], [d_h], SIZE + 1), d_distance.astype(np.float32), f["seen"].T @ d_h, ones @ d_h,
            f["h"].T @ d_g, ones @ d_g, f["h"].T @ d_inner, at_group[:, :INNER], f["inner"].T @ d_m,
            at_group[:, INNER:]]

    def train(self, windows: np.ndarray, weight: np.ndarray, rate: float, seed: int, batch: int = 128,
              state: list | None = None) -> list:
        """One pass of Adam over the windows in random order; goes on from ``state``, what an earlier pass returned."""
        order = np.random.default_rng(seed).permutation(len(windows))
        done, moments = state or (0, [(np.zeros_like(p), np.zeros_like(p)) for p in self.parameters()])
        steps, kept = -(-len(order) // batch), {}
        for t in range(steps):
            pick = order[t * batch:(t + 1) * batch]
            step = done + t + 1
            now = np.float32(rate * min(1, step / 8))  # the first steps are small, the moments are not known yet
            fade = np.float32(1 / (1 - 0.9 ** step)), np.float32(1 / (1 - 0.99 ** step))
            for p, g, (m, v) in zip(self.parameters(), self.gradients(windows[pick], weight[pick], kept), moments):
                m *= np.float32(0.9)
                m += np.float32(0.1) * g
                v *= np.float32(0.99)
                g = np.multiply(g, g)
                g *= np.float32(0.01)
                v += g
                np.sqrt(np.multiply(v, fade[1], out=g), out=g)
                g += np.float32(1e-7)
                np.divide(m, g, out=g)
                g *= now * fade[0]
                p -= g
        return [done + steps, moments]


def _add_rows(ids: np.ndarray, parts: list[np.ndarray], size: int) -> np.ndarray:
    """Sums of the rows by id, of the parts side by side."""
    out = np.zeros((size, sum(p.shape[1] for p in parts)), np.float32)
    if len(ids):
        order = np.argsort(ids.astype(np.int16), kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        at = 0
        for p in parts:
            out[ids[first], at:at + p.shape[1]] = np.add.reduceat(p.take(order, axis=0), first, axis=0)
            at += p.shape[1]
    return out


def blocks(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, nth): one row for every STEP tokens of each text."""
    n = -(-sizes // STEP)
    text = np.repeat(np.arange(len(sizes)), n)
    return text, np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)


def cut(stream: np.ndarray, begins: np.ndarray, sizes: np.ndarray, text: np.ndarray, nth: np.ndarray):
    """(windows, weight) of blocks of texts whose ``sizes`` tokens stand in ``stream`` from ``begins`` on."""
    # Place of each token within its text; what is before the text is BEGIN, what is behind it does not count.
    place = nth[:, None] * STEP + np.arange(SPAN)[None] - (KEYS - STEP + 1)
    inside = (place >= 0) & (place < sizes[text][:, None])
    at = np.where(inside, begins[text][:, None] + place, 0)
    windows = np.where(inside, stream[at] if len(stream) else 0, BEGIN).astype(np.int16)
    weight = inside[:, KEYS - STEP + 1:]
    # Targets need an id of the vocabulary even where they do not count.
    windows[:, KEYS - STEP + 1:][~weight] = 0
    return windows, weight
