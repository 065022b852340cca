"""Probabilistic automata inferred from labelled strings (state merging with a Hoeffding bound).

A frequency prefix tree of the samples is folded from the root outward: a blue state (child of a red one) merges into the
first red state whose end and transition frequencies, here and in all states below, differ by less than the bound allows;
otherwise it turns red. What remains is a deterministic automaton with a probability per symbol and for ending.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass, field

import numpy as np

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Characters from this place on are read as classes; before it a format's literal head counts.
HEAD = 4
_CLASS = {c: "h" for c in "abcdef"} | {c: "l" for c in LOWER[6:]} | {c: "U" for c in UPPER} | {c: "9" for c in DIGITS}
_SIZE = {"h": 6, "l": 20, "U": 26, "9": 10}


def symbols(text: str) -> list[str]:
    return ["=" + c if i < HEAD else _CLASS.get(c, c) for i, c in enumerate(text)]


@dataclass
class _State:
    count: int = 0
    ends: int = 0
    next: dict[str, int] = field(default_factory=dict)
    hits: dict[str, int] = field(default_factory=dict)


class Automaton:
    """Learned from samples; log_prob gives the log probability of a text, per character of its classes."""

    def __init__(self, samples: list[str], alpha: float = 0.05):
        self.states = [_State()]
        for s in samples:
            at = 0
            for x in symbols(s):
                node = self.states[at]
                node.count += 1
                node.hits[x] = node.hits.get(x, 0) + 1
                if x not in node.next:
                    node.next[x] = len(self.states)
                    self.states.append(_State())
                at = node.next[x]
            self.states[at].count += 1
            self.states[at].ends += 1
        self.width = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()

    def _differ(self, a: int, n: int, b: int, m: int) -> bool:
        return n > 0 and m > 0 and abs(a / n - b / m) > self.width * (n**-0.5 + m**-0.5)

    def _compatible(self, red: int, blue: int) -> bool:
        todo = [(red, blue)]
        while todo:
            i, j = todo.pop()
            p, q = self.states[i], self.states[j]
            if self._differ(p.ends, p.count, q.ends, q.count):
                return False
            for x in p.hits.keys() | q.hits.keys():
                if self._differ(p.hits.get(x, 0), p.count, q.hits.get(x, 0), q.count):
                    return False
                if x in p.next and x in q.next and p.next[x] != q.next[x]:
                    todo.append((p.next[x], q.next[x]))
        return True

    def _fold(self, red: int, blue: int) -> None:
        """Adds the tree below blue to what is below red."""
        todo = [(red, blue)]
        while todo:
            i, j = todo.pop()
            p, q = self.states[i], self.states[j]
            p.count += q.count
            p.ends += q.ends
            for x, k in q.next.items():
                p.hits[x] = p.hits.get(x, 0) + q.hits[x]
                if x in p.next:
                    todo.append((p.next[x], k))
                else:
                    p.next[x] = k

    def _merge(self) -> None:
        red = [0]
        while True:
            blue = [(i, x, k) for i in red for x, k in self.states[i].next.items() if k not in red]
            if not blue:
                break
            i, x, k = max(blue, key=lambda b: (self.states[b[2]].count, -b[2]))
            for r in red:
                if self._compatible(r, k):
                    self.states[i].next[x] = r
                    self._fold(r, k)
                    break
            else:
                red.append(k)
        number = {s: n for n, s in enumerate(red)}
        self.table = []
        for s in red:
            st = self.states[s]
            total = st.count + 1.0
            self.table.append(({x: (number[k], math.log(st.hits[x] / total)) for x, k in st.next.items()}, math.log((st.ends + 1e-3) / total)))
        del self.states

    def log_prob(self, text: str) -> float:
        """Natural log; a symbol that a state never saw costs as much as one in 10,000 and leaves the state."""
        at, total = 0, 0.0
        for i, (c, x) in enumerate(zip(text, symbols(text))):
            step = self.table[at][0].get(x)
            if step is None:
                total -= math.log(10_000)
            else:
                at, cost = step
                total += cost - (math.log(_SIZE.get(x, 1)) if i >= HEAD else 0.0)
        return total + self.table[at][1]


class Scorer:
    """Several automata side by side over many strings of bytes: log probabilities as Automaton.log_prob gives them."""

    def __init__(self, models: dict[str, Automaton]):
        self.kinds = list(models)
        size = max(len(m.table) for m in models.values())
        lost = -math.log(10_000)
        #: Next state and cost by automaton, state and byte (literal ones for the head, then classes).
        self.next = np.tile(np.arange(size, dtype=np.int32)[None, :, None], (len(models), 1, 512))
        self.cost = np.full((len(models), size, 512), lost)
        self.end = np.zeros((len(models), size))
        for g, m in enumerate(models.values()):
            for s, (steps, end) in enumerate(m.table):
                self.end[g, s] = end
                for x, (k, cost) in steps.items():
                    if x[0] == "=" and len(x) == 2:
                        places = [ord(x[1])] if ord(x[1]) < 256 else []
                        size_of = 1
                    else:
                        places = [256 + c for c in range(256) if _CLASS.get(chr(c), chr(c)) == x]
                        size_of = _SIZE.get(x, 1)
                    self.next[g, s, places] = k
                    self.cost[g, s, places] = cost - math.log(size_of)

    def log_probs(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Strings x automata."""
        order = np.argsort(starts - ends, kind="stable")  # the longest first, so that those still running stand in front
        at, lengths = starts[order], (ends - starts)[order]
        kinds = np.arange(len(self.kinds))[None, :]
        state = np.zeros((len(at), len(self.kinds)), np.int32)
        total = np.zeros((len(at), len(self.kinds)))
        left = np.searchsorted(-lengths, -np.arange(1, int(lengths[0]) + 1 if len(lengths) else 1), "right")
        for i, n in enumerate(left.tolist()):
            x = data[at[:n] + i].astype(np.int64)[:, None] + (256 if i >= HEAD else 0)
            own = state[:n]
            total[:n] += self.cost[kinds, own, x]
            state[:n] = self.next[kinds, own, x]
        out = np.empty_like(total)
        out[order] = total + self.end[kinds, state]
        return out


def _draw(rng: random.Random, alphabet: str, lo: int, hi: int | None = None) -> str:
    return "".join(rng.choices(alphabet, k=rng.randint(lo, hi or lo)))


def labelled_samples(n: int = 120, seed: int = 7) -> dict[str, list[str]]:
    """Examples of public credential formats and, under "plain", of long strings that are none. Made by rule from a seed."""
    rng = random.Random(seed)
    alnum, b64 = UPPER + LOWER + DIGITS, UPPER + LOWER + DIGITS + "+/"
    syllables = [a + b for a in "bcdfghklmnprstvw" for b in ("a", "e", "i", "o", "u", "er", "en", "tion", "ing", "st")]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    plain = [
        lambda: f"//{word()}.{word()}.com/{word()}/{rng.randint(1, 9999)}",
        lambda: f"{word()}.{word()}{rng.randint(1, 99)}.{word()}.org",
        lambda: f"{word()}_{word()}_{rng.randint(1, 2030)}.{word()}",
        lambda: f"{word()}-{word()}-{word()}-{rng.randint(1, 99)}",
        lambda: f"/{word()}/{word()}/{word()}{rng.randint(0, 9)}.html",
        lambda: f"{word()}{word()}{word()}{word()}{rng.randint(0, 99)}",
        lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1, 12)}-{rng.randint(1, 28)}T{rng.randint(10, 23)}.{rng.randint(10, 59)}",
        lambda: f"{word()}={rng.randint(1, 999)}={word()}={word()}",
        lambda: f"{word()}{word()}{word()}{word()}{word()}".upper() + str(rng.randint(0, 9)),
        lambda: _draw(rng, DIGITS, 4, 24),
        lambda: rng.choice(["-", "_", "=", ".", "/"]) * rng.randint(3, 40),
        lambda: f"{word().capitalize()}{word().capitalize()}{word()}",
        lambda: "".join(word() for _ in range(rng.randint(3, 9))),
    ]
    return {
        "access_key": ["AKIA" + _draw(rng, UPPER + DIGITS, 16) for _ in range(n)],
        "secret_key": [_draw(rng, b64, 40) for _ in range(2 * n)],
        "hex_key": [_draw(rng, DIGITS + "abcdef", rng.choice([32, 40, 64])) for _ in range(2 * n)],
        "git_token": [rng.choice(["ghp_", "gho_", "ghs_"]) + _draw(rng, alnum, 36) for _ in range(n)],
        "chat_token": ["xoxb-" + _draw(rng, DIGITS, 11) + "-" + _draw(rng, DIGITS, 11) + "-" + _draw(rng, alnum, 24) for _ in range(n)],
        "map_key": ["AIza" + _draw(rng, alnum + "-_", 35) for _ in range(n)],
        "pay_key": [rng.choice(["sk_live_", "pk_live_"]) + _draw(rng, alnum, 24) for _ in range(n)],
        "web_token": ["eyJ" + _draw(rng, alnum, 33) + ".eyJ" + _draw(rng, alnum, 60, 90) + "." + _draw(rng, alnum + "-_", 43) for _ in range(n)],
        "plain": [rng.choice(plain)() for _ in range(6 * n)],
    }


def with_labelled(samples: dict[str, list[str]], labelled: dict[str, list[str]], least: int = 20) -> dict[str, list[str]]:
    """samples with a format more for each label that has `least` or more different strings; sorted, as the order of samples breaks ties of merging."""
    return samples | {f"labelled_{k}": sorted(set(own)) for k, own in sorted(labelled.items()) if len(set(own)) >= least}


def train(samples: dict[str, list[str]]) -> dict[str, Automaton]:
    return {kind: Automaton(own) for kind, own in samples.items()}


def best_kind(models: dict[str, Automaton], text: str) -> tuple[str, float]:
    """(likeliest format, its lead in log probability per character over "plain")."""
    base = models["plain"].log_prob(text)
    kind, value = max(((k, m.log_prob(text)) for k, m in models.items() if k != "plain"), key=lambda x: x[1])
    return kind, (value - base) / len(text)
