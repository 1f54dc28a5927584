"""Grammar inference for credential formats: prefix trees of labelled strings whose statistically compatible states
are merged (the ALERGIA test) into probabilistic automata, one a label.

A label's strings are first aligned: characters that all of them hold equally often part them into segments, and of each
segment the common prefix is literal and the rest is of the smallest character set that covers it. The prefix tree is
over literals and sets, so ``ghp_`` is spelt out in the automaton and a tail's length is learnt. Ordinary strings are read
as classes of characters. Within a set or class characters count as equally likely, which both kinds of likelihood
contain, so they are comparable.
"""

from __future__ import annotations

import math
import os
import random
import string
from collections import deque
from functools import lru_cache

ALPHA = 0.05
#: Visits credited to what was never seen: next to none in a credential's automaton, as its format is fixed.
FLOOR, STRICT = 1e-3, 1e-12

_CLASS = {**dict.fromkeys("abcdef", "a"), **dict.fromkeys("ghijklmnopqrstuvwxyz", "g"), **dict.fromkeys("ABCDEF", "A"), **dict.fromkeys("GHIJKLMNOPQRSTUVWXYZ", "G"), **dict.fromkeys("0123456789", "0")}
CLASSES = str.maketrans(_CLASS)
ALPHABET = "agAG0+/_.=-"
#: Log of one over the size of each class.
_WITHIN = {c: -math.log(sum(v == c for v in _CLASS.values()) or 1) for c in ALPHABET}
#: Character sets of which a tail may be, from the smallest.
SETS = [string.digits, "0123456789abcdef", "0123456789ABCDEF", string.ascii_lowercase, string.ascii_uppercase, string.digits + string.ascii_lowercase, string.digits + string.ascii_uppercase, string.ascii_letters, string.ascii_letters + string.digits, string.ascii_letters + string.digits + "_-", string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "+/_.=-"]


class Reader:
    """How the strings of one label are read: symbols and the log-likelihood of the characters within them."""

    def __init__(self, strings: list[str]):
        marks = {c for c in "".join(strings) if not c.isalnum()}
        self.marks = {c for c in marks if len({s.count(c) for s in strings}) == 1}
        self.segments = []
        for parts in zip(*map(self._parts, strings), strict=True):
            literal = os.path.commonprefix(parts)
            rest = set("".join(p[len(literal) :] for p in parts))
            k = next(i for i, chars in enumerate(SETS) if rest <= set(chars))
            self.segments.append((literal, frozenset(SETS[k]), chr(0xE000 + k), -math.log(len(SETS[k]))))

    def _parts(self, s: str) -> list[str]:
        """Segments in order, marks as segments of their own."""
        out = [""]
        for c in s:
            if c in self.marks:
                out += [c, ""]
            else:
                out[-1] += c
        return out

    def __call__(self, s: str) -> tuple[str, float]:
        out, within = [], 0.0
        for i, part in enumerate(self._parts(s)):
            literal, chars, symbol, size = self.segments[i] if i < len(self.segments) else ("", (), "", 0.0)
            for k, c in enumerate(part):
                if k >= len(literal) and c in chars:
                    out.append(symbol)
                    within += size
                else:
                    out.append(c)
        return "".join(out), within


def read_classes(s: str) -> tuple[str, float]:
    classes = s.translate(CLASSES)
    return classes, sum(_WITHIN.get(c, 0.0) for c in classes)


class Automaton:
    """Of strings of symbols. State s: ends[s] of visits[s] strings end there; moves[s] maps a symbol to (target, count)."""

    def __init__(self, strings: list[str], alpha: float = ALPHA, floor: float = FLOOR):
        self.floor = floor
        self.visits, self.ends, self.moves = [0], [0], [{}]
        for s in strings:
            at = 0
            self.visits[0] += 1
            for c in s:
                if c not in self.moves[at]:
                    self.moves[at][c] = [len(self.visits), 0]
                    self.visits.append(0)
                    self.ends.append(0)
                    self.moves.append({})
                step = self.moves[at][c]
                step[1] += 1
                at = step[0]
                self.visits[at] += 1
            self.ends[at] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()
        self._log = self._tables()

    def _differs(self, f: int, n: int, g: int, m: int) -> bool:
        return n > 0 and m > 0 and abs(f / n - g / m) > self.bound * (n**-0.5 + m**-0.5)

    def _compatible(self, p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            a, b = todo.pop()
            if self._differs(self.ends[a], self.visits[a], self.ends[b], self.visits[b]):
                return False
            for c in self.moves[a].keys() | self.moves[b].keys():
                x, y = self.moves[a].get(c), self.moves[b].get(c)
                if self._differs(x[1] if x else 0, self.visits[a], y[1] if y else 0, self.visits[b]):
                    return False
                if x and y:
                    todo.append((x[0], y[0]))
        return True

    def _fold(self, p: int, q: int) -> None:
        """Adds the tree under q to state p."""
        todo = [(p, q)]
        while todo:
            a, b = todo.pop()
            self.visits[a] += self.visits[b]
            self.ends[a] += self.ends[b]
            for c, (target, n) in self.moves[b].items():
                if c in self.moves[a]:
                    self.moves[a][c][1] += n
                    todo.append((self.moves[a][c][0], target))
                else:
                    self.moves[a][c] = [target, n]

    def _merge(self) -> None:
        """Settled states grow breadth first; each new state merges with the first settled state that it agrees
        with, or else settles. A settled state's subtree below the frontier is always a tree."""
        settled, order = {0}, [0]
        frontier = deque((0, c) for c in sorted(self.moves[0]))
        while frontier:
            s, c = frontier.popleft()
            target = self.moves[s][c][0]
            if target in settled:
                continue
            mate = next((r for r in order if self._compatible(r, target)), None)
            if mate is None:
                settled.add(target)
                order.append(target)
                frontier.extend((target, x) for x in sorted(self.moves[target]))
            else:
                before = {(r, x) for r in order for x in self.moves[r]}
                self.moves[s][c][0] = mate
                self._fold(mate, target)
                frontier.extend(sorted((r, x) for r in order for x in self.moves[r] if (r, x) not in before))
        self.states = order

    def _tables(self) -> dict[int, tuple[float, dict[str, tuple[int, float]]]]:
        out = {}
        for s in self.states:
            total = self.visits[s] + self.floor * (len(ALPHABET) + 1)
            out[s] = math.log((self.ends[s] + self.floor) / total), {c: (t, math.log((n + self.floor) / total)) for c, (t, n) in self.moves[s].items()}, math.log(self.floor / total)
        return out

    def log_likelihood(self, symbols: str) -> float:
        """An unseen step costs the floor and starts again at the root."""
        at, total, table = 0, 0.0, self._log
        for c in symbols:
            _, moves, floor = table[at]
            step = moves.get(c)
            if step is None:
                at, total = 0, total + floor
            else:
                at, total = step[0], total + step[1]
        return total + table[at][0]


def _of(rng: random.Random, chars: str, n: int) -> str:
    return "".join(rng.choice(chars) for _ in range(n))


#: Public credential formats, as (label, parts); a part is a literal or (characters, least, most). Bare
#: hexadecimal is left to the base pattern: shorter runs are as often hashes and serial numbers.
_UP, _ALNUM, _URL64 = string.ascii_uppercase + string.digits, string.ascii_letters + string.digits, string.ascii_letters + string.digits + "_-"
FORMATS = [
    ("cloud_access", ["AKIA", (_UP, 16, 16)]),
    ("cloud_secret", [(string.ascii_letters + string.digits + "+/", 40, 40)]),
    ("forge_token", ["ghp_", (_ALNUM, 36, 36)]),
    ("chat_token", ["xoxb-", (string.digits, 11, 13), "-", (string.digits, 11, 13), "-", (_ALNUM, 24, 24)]),
    ("maps_key", ["AIza", (_URL64, 35, 35)]),
    ("pay_key", ["sk_live_", (_ALNUM, 24, 24)]),
    ("web_token", ["eyJ", (_URL64, 30, 60), ".eyJ", (_URL64, 40, 90), ".", (_URL64, 43, 43)]),
]


def labelled(per_label: int, seed: int) -> dict[str, list[str]]:
    """Labelled credentials, drawn from the public formats."""
    out = {}
    for label, parts in FORMATS:
        rng = random.Random(f"{seed}:{label}")
        out[label] = ["".join(p if isinstance(p, str) else _of(rng, p[0], rng.randint(p[1], p[2])) for p in parts) for _ in range(per_label)]
    return out


def ordinary(per_label: int, seed: int) -> dict[str, list[str]]:
    """What else looks like a candidate: names with numbers, hosts, paths, dates, versions, identifiers, numbers."""
    rng = random.Random(f"{seed}:ordinary")
    vowels, others = "aeiou", "bcdfghlmnprstvwyz"
    word = lambda a=2, b=4: "".join(rng.choice(others) + rng.choice(vowels) + rng.choice(["", "", "n", "r", "s", "t"]) for _ in range(rng.randint(a, b)))
    num = lambda a, b: _of(rng, string.digits, rng.randint(a, b))
    kinds = {
        "mail_host": lambda: f"{word()}{num(1, 2)}.{word()}.{rng.choice(['com', 'org', 'net'])}",
        "host": lambda: f"{word()}.{num(1, 3)}.{word()}{num(1, 2)}.{word()}.{rng.choice(['com', 'org', 'net'])}",
        "path": lambda: f"{word()}/{word()}/{num(1, 5)}/{word()}.html",
        "dated": lambda: f"20{num(2, 2)}-{num(2, 2)}-{num(2, 2)}-{word()}-{word()}",
        "version": lambda: f"{word()}-{num(1, 2)}.{num(1, 2)}.{num(1, 2)}-{word()}",
        "snake": lambda: f"{word()}_{word()}_{word()}_{num(1, 4)}",
        "camel": lambda: f"{word().capitalize()}{word().capitalize()}{word().capitalize()}{num(1, 3)}",
        "numbered": lambda: f"{word(4, 8)}{num(1, 4)}",
        "phone": lambda: f"{num(2, 4)}-{num(2, 4)}-{num(2, 4)}-{num(2, 4)}x{num(1, 2)}",
        "slug": lambda: f"{word()}-{word()}-{word()}-{num(1, 3)}",
        "order": lambda: f"{word().upper()}-{word().upper()}-{num(2, 6)}-{word().upper()}",
        "query": lambda: f"{word()}={word()}{num(1, 3)}.{word()}={num(1, 3)}",
        "uuid": lambda: "-".join(_of(rng, "0123456789abcdef", n) for n in (8, 4, 4, 4, 12)),
        "identifier": lambda: _of(rng, _ALNUM, rng.randint(16, 36)),
        "long_identifier": lambda: _of(rng, _ALNUM, rng.randint(42, 90)),
        "serial": lambda: _of(rng, _UP, rng.randint(16, 36)),
        "lower_identifier": lambda: _of(rng, string.ascii_lowercase + string.digits, rng.randint(16, 50)),
        "hex": lambda: _of(rng, "0123456789abcdef", rng.choice([16, 24, 32, 40, 64])),
        "upper_hex": lambda: _of(rng, "0123456789ABCDEF", rng.choice([16, 24, 32, 40, 64])),
        "digest": lambda: _of(rng, _ALNUM + "+/", rng.choice([22, 27, 43])),
        "mail_part": lambda: _of(rng, _ALNUM + "+/", rng.choice([60, 64, 72, 76])),
        "url_identifier": lambda: _of(rng, _URL64, rng.choice([16, 20, 21, 22, 27, 32, 43])),
    }
    out = {}
    for label, draw in kinds.items():
        found = []
        while len(found) < per_label:
            if len(s := draw()) >= 16:
                found.append(s)
        out[label] = found
    return out


class Model:
    """score(candidate): log of the ratio of the candidate's likelihood by the best credential automaton to that by the
    best ordinary one. The threshold lies above all ordinary strings held out."""

    def __init__(self, credentials: dict[str, list[str]], ordinary_: dict[str, list[str]], held_out: list[str]):
        self.readers = {label: Reader(found) for label, found in credentials.items()}
        self.automata = {label: Automaton([self.readers[label](s)[0] for s in found], floor=STRICT) for label, found in credentials.items()}
        self.ordinary = {label: Automaton([read_classes(s)[0] for s in found]) for label, found in ordinary_.items()}
        self.threshold = max([0.0, *map(self.score, held_out)]) + 0.25

    def label(self, candidate: str) -> tuple[float, str]:
        """The best credential automaton and its log-likelihood."""
        out = []
        for label, automaton in self.automata.items():
            symbols, within = self.readers[label](candidate)
            out.append((automaton.log_likelihood(symbols) + within, label))
        return max(out)

    def score(self, candidate: str) -> float:
        classes, within = read_classes(candidate)
        return self.label(candidate)[0] - within - max(a.log_likelihood(classes) for a in self.ordinary.values())

    def is_credential(self, candidate: str) -> bool:
        return self.score(candidate) > self.threshold


@lru_cache(maxsize=2)
def default_model(per_label: int = 150, seed: int = 7) -> Model:
    return Model(labelled(per_label, seed), ordinary(per_label, seed), [s for v in ordinary(per_label, seed + 1).values() for s in v])
