"""Secret scans: rules, and a character CNN that judges every further candidate.

The rules (assignments to credential names, access keys, long hex runs) give the
base spans, which always stay.  Every other token of 8 or more credential
characters is a candidate, with or without digits, and is scored by a small
character CNN in numpy: filters over the whole token, pooled over all its places
by maximum and mean, and filters over its surroundings, whose say is bounded.
Since it is bounded, a token whose own part is too low for any surroundings is
rejected once for all its occurrences.

The network is trained here on what the rules find in all documents, with the
credential's name masked, and on copies of those findings in other alphabets and
lengths, so that it learns what credentials look like and not what the rules say.
Candidates that no rule meets are unlabelled: those that networks trained without
them take for secrets are left out of the negatives.  Access keys are held out of
the training; the threshold must keep the wanted recall on them, and on copies of
other held-out findings in all alphabets.

Every distinct finding of every document is one row.  Spark deals the rows into
cells of bounded size; in a round each cell's task goes on from the same network,
and the weights that come out are averaged by an aggregation over whole numbers,
so that the order in which tasks end does not matter.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Callable, Container, Iterator
from dataclasses import dataclass, field, replace
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from geoquilt.storage import discard, stored

KINDS = ("assign", "access", "hex", "cnn")
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"(?<![\w+/=.-])[A-Za-z0-9+/_.=-]{7,}[A-Za-z0-9+/_=](?![\w+/=-])")
_PARTS = re.compile(r"[/.=+]+")
#: Bytes that cannot stand in a candidate nor beside it in one word become spaces; hex digits are told from all others.
_GAPS = bytes(c if c > 127 or re.match(r"[\w+/=.-]", chr(c)) else 32 for c in range(256))
_LONG = re.compile(b" [^ ]{8,}")
_HEX_DIGITS = bytes(chr(c) in "0123456789abcdef" for c in range(256))
_DIGIT = re.compile("[0-9]")
MIN_PART = 8
#: Characters of the surroundings: before the candidate and behind it.
BEFORE, BEHIND = 24, 8
#: Width of the filters, and the surroundings' say in the logit at most.
SPAN, SAY = 5, 2.0
#: Places of a token that are looked at together.
STRETCH = 4096
#: Candidates of texts that are looked at together.
MANY = 20_000
HELD_OUT_KIND = "access"
SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
REDACTED = "[SECRET]"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The rules' spans (start, end, kind), by start, then kind as listed."""
    return [(s, e, k) for s, e, k, _ in _rule_findings(text)]


def _rule_findings(text: str) -> list[tuple[int, int, str, int]]:
    """The rules' spans with the place where the credential itself begins."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), "assign", m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # of a run of 24 hex digits each third byte shows 8 in a row
    if b"\1" * 8 in text.encode()[::3].translate(_HEX_DIGITS):
        found += [(m.start(), m.end(), "hex", m.start()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str) -> list[str]:
    """All matches of ``CANDIDATE``, asked only in words long enough to hold one."""
    words = _LONG.findall(b" " + text.encode().translate(_GAPS))
    return CANDIDATE.findall(b"".join(words).decode())


class Overlap:
    """Whether a span meets one of many, in logarithmic time."""

    def __init__(self, spans: list[tuple[int, int, str]]) -> None:
        self.starts = [s for s, _, _ in spans]  # sorted
        self.upto = list(accumulate((e for _, e, _ in spans), max))

    def __call__(self, start: int, end: int) -> bool:
        n = bisect_left(self.starts, end)
        return n > 0 and self.upto[n - 1] > start


def surroundings(text: str, start: int, end: int, masked: int | None = None) -> bytes:
    """What stands before and behind a span, padded to fixed places; characters beyond ASCII are 1, none is 0.

    From ``masked`` up to the span letters are 1 too.
    """
    cut = lambda s: s.encode("ascii", "replace").replace(b"?", b"\x01")
    before = text[max(0, start - BEFORE) : start]
    if masked is not None and masked < start:
        keep = max(0, len(before) - (start - masked))
        before = before[:keep] + re.sub(r"[A-Za-z]", "\x01", before[keep:])
    return cut(before).rjust(BEFORE, b"\0") + cut(text[end : end + BEHIND]).ljust(BEHIND, b"\0")


def parts_of(token: str) -> list[str]:
    """A token and its parts between slashes, dots and the like, if they are long enough."""
    if token.isalnum():
        return [token]
    parts = [p for p in _PARTS.split(token) if len(p) >= MIN_PART]
    return [token, *(p for p in parts if p != token)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.clip(x, -60, 60)))


def _codes(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of tokens with two empty places on both sides, and their lengths."""
    n = np.array([len(t) for t in tokens])
    codes = np.zeros((len(tokens), int(n.max()) + SPAN - 1), np.uint8)
    codes[:, 2:-2][np.arange(n.max()) < n[:, None]] = np.frombuffer(b"".join(tokens), np.uint8) & 127
    return codes, n


@dataclass(frozen=True)
class CharCnn:
    """One convolution over the token and one over its surroundings, both over the same embedding; calibrated.

    ``recall`` is that of held-out findings at the threshold, ``passed`` the share
    of held-out unlabelled candidates that reach it.
    """

    embed: np.ndarray  # (128, d)
    kernel: np.ndarray  # (SPAN * d, filters)
    bias: np.ndarray  # (filters,)
    out: np.ndarray  # (2 * filters,): of the maxima, of the means
    out_bias: np.ndarray  # (1,)
    around_kernel: np.ndarray
    around_bias: np.ndarray
    around_out: np.ndarray  # (filters,)
    around_shift: np.ndarray  # (1,)
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5
    recall: float = 1.0
    passed: float = 0.0
    own: dict = field(default_factory=dict, compare=False, repr=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "own": {}}

    def token_logits(self, tokens: list[str]) -> np.ndarray:
        """The token's part of the logit: the largest over the whole token and its parts."""
        pieces, owners = [t.encode("ascii") for t in tokens], list(range(len(tokens)))
        for i, t in enumerate(tokens):
            if not t.isalnum():
                parts = parts_of(t)[1:]
                pieces += [p.encode("ascii") for p in parts]
                owners += [i] * len(parts)
        best, owners = np.full(len(tokens), -np.inf), np.array(owners)
        lengths = np.array([len(p) for p in pieces])
        order = np.argsort(lengths, kind="stable")
        lengths, at = lengths[order], 0
        while at < len(order):
            upto = int(np.searchsorted(lengths, lengths[at] + 16, "right"))
            upto = min(upto, at + max(1, 2 * STRETCH // int(lengths[upto - 1])))
            group = order[at:upto]
            np.maximum.at(best, owners[group], _token_scores(self, [pieces[i] for i in group]))
            at = upto
        return best

    def known_logits(self, tokens: set[str]) -> dict[str, float]:
        """Token logits, remembered for the next texts."""
        if len(self.own) > 300_000:
            self.own.clear()
        new = sorted(tokens.difference(self.own))
        if new:
            self.own.update(zip(new, self.token_logits(new).tolist(), strict=True))
        return self.own

    def scores(self, tokens: list[str], around: list[bytes]) -> np.ndarray:
        """Calibrated probability of each candidate in its surroundings."""
        if not tokens:
            return np.zeros(0)
        known = self.known_logits(set(tokens))
        say = np.concatenate([_around(self, _around_codes(around[i : i + 2048]))[0] for i in range(0, len(around), 2048)])
        return _sigmoid(self.slope * (np.array([known[t] for t in tokens]) + say) + self.shift)

    def least_logit(self) -> float:
        """A token below it stays below the threshold whatever stands around it."""
        t = min(max(self.threshold, 1e-12), 1 - 1e-12)
        return (float(np.log(t / (1 - t))) - self.shift) / self.slope - SAY


def _around_codes(around: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(around), np.uint8).reshape(len(around), BEFORE + BEHIND) & 127


def _columns(net: CharCnn, codes: np.ndarray) -> np.ndarray:
    """Embedded stretches of ``SPAN`` codes, one for each place."""
    x = np.lib.stride_tricks.sliding_window_view(net.embed[codes], SPAN, axis=1).transpose(0, 1, 3, 2)
    return x.reshape(len(codes), codes.shape[1] - SPAN + 1, -1)


def _filtered(embed: np.ndarray, kernel: np.ndarray, bias: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The filters at every place, by what each code adds at each of their places."""
    table = (embed @ kernel.reshape(SPAN, embed.shape[1], -1)).astype(bias.dtype)
    places = codes.shape[1] - SPAN + 1
    act = table[0].take(codes[:, :places], 0)
    for k in range(1, SPAN):
        act += table[k].take(codes[:, k : k + places], 0)
    act += bias
    return np.maximum(act, 0, out=act)


def _token_scores(net: CharCnn, tokens: list[bytes]) -> np.ndarray:
    codes, n = _codes(tokens)
    f = len(net.bias)
    top, total = np.zeros((2, len(tokens), f), net.bias.dtype)
    for at in range(0, codes.shape[1] - SPAN + 1, STRETCH):
        act = _filtered(net.embed, net.kernel, net.bias, codes[:, at : at + STRETCH + SPAN - 1])
        act *= (np.arange(at, at + act.shape[1])[None] < n[:, None])[:, :, None]
        top, total = np.maximum(top, act.max(1)), total + act.sum(1)
    # row by row, lest a token's logit depend on those judged beside it
    return (np.concatenate([top, total / n[:, None]], 1) * net.out).sum(1) + net.out_bias[0]


def _around(net: CharCnn, codes: np.ndarray) -> tuple[np.ndarray, tuple]:
    act = _filtered(net.embed, net.around_kernel, net.around_bias, codes)
    at = act.argmax(1)
    top = np.take_along_axis(act, at[:, None], 1)[:, 0]
    say = SAY * np.tanh(top @ net.around_out + net.around_shift[0])
    return say, (at, top)


NAMES = ("embed", "kernel", "bias", "out", "out_bias", "around_kernel", "around_bias", "around_out", "around_shift")


def _stretches(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Codes of ``STRETCH`` places at a time, and the first place."""
    for at in range(0, codes.shape[1] - SPAN + 1, STRETCH):
        yield at, codes[:, at : at + STRETCH + SPAN - 1]


def _acts(net: CharCnn, codes: np.ndarray, n: np.ndarray, at: int) -> tuple[np.ndarray, ...]:
    """The places of a stretch within its tokens, end to end: tokens that have some, where each begins, each place's token, codes and filters."""
    count = np.clip(n - at, 0, codes.shape[1] - SPAN + 1)
    rows = np.flatnonzero(count)
    count = count[rows]
    starts = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(rows)), count)
    first = (rows * codes.shape[1] - starts)[owner] + np.arange(len(owner))
    seen = codes.ravel()[first[:, None] + np.arange(SPAN)]
    return rows, starts, owner, seen, _filtered(net.embed, net.kernel, net.bias, seen)[:, 0]


def _logits(net: CharCnn, codes: np.ndarray, n: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, tuple]:
    f = len(net.bias)
    top, best = np.zeros((len(codes), f), net.bias.dtype), np.full((len(codes), f), -1)
    total, last = np.zeros_like(top), None
    for at, part in _stretches(codes):
        last = rows, starts, owner, _, act = _acts(net, part, n, at)
        value = np.maximum.reduceat(act, starts, 0)
        place, filt = np.nonzero((act == value[owner]) & (value > top[rows])[owner])
        place, filt = place[::-1], filt[::-1]  # the first of equal places is written last
        best[rows[owner[place]], filt] = at + place - starts[owner[place]]
        top[rows] = np.maximum(top[rows], value)
        total[rows] += np.add.reduceat(act, starts, 0)
    pooled = np.concatenate([top, total / n[:, None].astype(top.dtype)], 1)
    some = around.any(1)  # rows with nothing around are alike
    rows = np.append(np.flatnonzero(some), np.flatnonzero(~some)[:1])
    place = np.full(len(around), len(rows) - 1)
    place[some] = np.arange(some.sum())
    say, kept = _around(net, around[rows])
    return pooled @ net.out + net.out_bias[0] + say[place], (last if codes.shape[1] < STRETCH + SPAN else None, best, pooled, (rows, place, say, *kept))


def _gradients(net: CharCnn, codes: np.ndarray, n: np.ndarray, around: np.ndarray, d_logit: np.ndarray, kept: tuple) -> dict[str, np.ndarray]:
    """Stretches of long tokens are computed once more, so that memory does not grow with their length."""
    whole, best, pooled, (a_rows, a_place, say, a_at, a_top) = kept
    f, d = len(net.bias), net.embed.shape[1]
    d_pool = d_logit[:, None] * net.out[None]
    d_mean = d_pool[:, f:] / n[:, None].astype(d_pool.dtype)
    d_say = np.bincount(a_place, d_logit, len(a_rows)).astype(d_logit.dtype) * SAY * (1 - (say / SAY) ** 2)
    d_top = d_say[:, None] * net.around_out[None] * (a_top > 0)
    g = {
        "out": pooled.T @ d_logit, "out_bias": np.array([d_logit.sum()]), "bias": np.zeros_like(net.bias), "kernel": np.zeros_like(net.kernel),
        "around_out": a_top.T @ d_say, "around_shift": np.array([d_say.sum()]), "around_bias": d_top.sum(0), "embed": np.zeros_like(net.embed),
    }
    for at, part in _stretches(codes):
        rows, starts, owner, seen, act = whole or _acts(net, part, n, at)
        d_act = d_mean[rows][owner] * (act > 0)
        here = best[rows] - at
        row, filt = np.nonzero((here >= 0) & (here < part.shape[1] - SPAN + 1))
        d_act[starts[row] + here[row, filt], filt] += d_pool[rows[row], filt]
        g["bias"] += d_act.sum(0)
        g["kernel"] += _columns(net, seen)[:, 0].T @ d_act
        g["embed"] += _by_code(seen, d_act @ net.kernel.T)
    picked = around[a_rows][np.arange(len(a_rows))[:, None, None], a_at[:, :, None] + np.arange(SPAN)]
    cell = (picked + 128 * np.arange(SPAN)) * f + np.arange(f)[:, None]  # by place in the filter, code and filter
    d_table = np.bincount(cell.ravel(), np.repeat(d_top.ravel(), SPAN), SPAN * 128 * f).reshape(SPAN, 128, f)
    g["around_kernel"] = (net.embed.T @ d_table).reshape(SPAN * d, f)
    g["embed"] += (d_table @ net.around_kernel.reshape(SPAN, d, f).transpose(0, 2, 1)).sum(0)
    return g


def _by_code(codes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the values of each code."""
    codes, values = codes.ravel(), values.reshape(codes.size, -1)
    return np.stack([np.bincount(codes, values[:, j], 128) for j in range(values.shape[1])], 1)


# --- training -----------------------------------------------------------------

LOWER_HEX, UPPER_HEX = "0123456789abcdef", "0123456789ABCDEF"
DIGITS, SMALL, BIG = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Alphabets of made credentials; that of the held-out kind is not among them.
ALPHABETS = (LOWER_HEX, UPPER_HEX, SMALL + DIGITS, SMALL + BIG + DIGITS, SMALL + BIG + DIGITS, SMALL + BIG + DIGITS + "+/", SMALL + BIG + DIGITS + "_-")


def restyled(token: str, rng: random.Random) -> str:
    """A made credential: random characters of another alphabet and length, at times with a short prefix."""
    made = "".join(rng.choices(rng.choice(ALPHABETS), k=rng.randrange(14, max(20, min(64, 2 * len(token))))))
    return "".join(rng.choices(SMALL, k=rng.randrange(2, 5))) + rng.choice("_-") + made if rng.random() < 0.3 else made


def composed(words: list[str], rng: random.Random) -> str:
    """A made name out of beginnings of ``words``, some with their letters mixed up, as words of other texts are strange.

    Constants, paths, dotted, camel-case and versioned names, single words of any case.
    """
    mixed = lambda p: "".join(rng.sample(p, len(p)))
    parts = [w[: rng.randrange(2, 11)] for w in rng.choices(words, k=rng.randrange(1, 6))]
    parts = [mixed(p) if rng.random() < 0.3 else p for p in parts]
    digits = lambda: "".join(rng.choices(DIGITS, k=rng.randrange(1, 4)))
    match rng.randrange(10):
        case 0:
            made = "_".join(parts).upper()
        case 1:
            made = "-".join(p.capitalize() if rng.random() < 0.5 else p.upper() for p in parts)
        case 2:
            made = "/".join(p + digits() if rng.random() < 0.2 else p for p in parts) + rng.choice(["", "/", "." + parts[0][:3]])
        case 3:
            made = parts[0] + "".join(p.capitalize() for p in parts[1:])
        case 4:
            made = "_".join(p + digits() if rng.random() < 0.4 else p for p in parts)
        case 5:
            made = ".".join(parts)
        case 6:
            made = "-".join(parts) + "-" + ".".join(digits() for _ in range(rng.randrange(1, 5)))
        case 7:
            made = "".join(parts[:2]).upper()
        case 8:
            made = rng.choice("=/_").join(parts) + rng.choice(["", digits()])
        case _:
            made = mixed("".join(parts[:2]))
            made = made.capitalize() if rng.random() < 0.3 else made
    return made if len(made) >= MIN_PART else made + "".join(parts)[:MIN_PART]


class Finding(NamedTuple):
    """A candidate: its token, what stands around it, and the rule that found it (null: none)."""

    token: str
    around: bytes
    kind: str | None


def findings(text: str, known: Container[str] = ()) -> list[Finding]:
    """The credentials that rules find in a text, with their names masked, and the candidates, less those that are known."""
    spans = _rule_findings(text)
    found, met = [], Overlap([(s, e, k) for s, e, k, _ in spans])
    for start, end, kind, value in spans:
        if end - value >= MIN_PART:
            found.append(Finding(text[value:end], surroundings(text, value, end, start), kind))
    end = 0
    for token in candidates(text):
        if token in known:
            continue
        start = text.find(token, end)
        while not (m := CANDIDATE.match(text, start)) or m[0] != token:  # it also stands inside of something else
            start = text.find(token, start + 1)
        end = m.end()
        if not met(start, end):
            found.append(Finding(token, surroundings(text, start, end), None))
    return found


def _calibrated(logits: np.ndarray, y: np.ndarray, rows: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a ridge logistic fit with classes of equal weight, by Newton steps; each logit stands for so many rows."""
    x = np.stack([logits, np.ones_like(logits)], 1)
    share = float(rows[y > 0].sum() / rows.sum())
    c = rows * np.where(y > 0, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
    w = np.array([1.0, 0.0])
    for _ in range(25):
        p = _sigmoid(x @ w)
        pull = 0.1 * (w - np.array([1.0, 0.0]))
        w = w - np.linalg.solve((x * (c * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), x.T @ (c * (p - y)) + pull)
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


#: Rows of a cell on average, of a batch, and places of a padded group of tokens that are looked at together.
CELL, BATCH, PLACES = 9_000, 128, 16 * STRETCH
#: Steps of a weight, and of a logit, when they are summed and counted as whole numbers.
WEIGHT_STEP, LOGIT_STEP = 2.0**-32, 2.0**-8
NOTHING = b"\0" * (BEFORE + BEHIND)


def _group(token: str) -> int:
    """Tokens of small letters, with big ones or signs, with digits."""
    return (0 if token.islower() else 1) if token.isalpha() or not _DIGIT.search(token) else 2


def _start(dim: int, filters: int, seed: int) -> CharCnn:
    rng = np.random.default_rng(seed)
    scale = (2 / (SPAN * dim)) ** 0.5
    return CharCnn(
        embed=rng.normal(0, 0.5, (128, dim)), kernel=rng.normal(0, scale, (SPAN * dim, filters)), bias=np.zeros(filters),
        out=rng.normal(0, 0.1, 2 * filters), out_bias=np.zeros(1), around_kernel=rng.normal(0, scale, (SPAN * dim, filters)),
        around_bias=np.zeros(filters), around_out=rng.normal(0, 0.1, filters), around_shift=np.zeros(1),
    )


def _flat(net: CharCnn) -> np.ndarray:
    return np.concatenate([getattr(net, k).ravel() for k in NAMES])


def _shaped(net: CharCnn, flat: np.ndarray) -> CharCnn:
    """A network of the shape of ``net`` with other weights."""
    parts = np.split(flat, np.cumsum([getattr(net, k).size for k in NAMES])[:-1])
    return replace(net, **{k: p.reshape(getattr(net, k).shape) for k, p in zip(NAMES, parts, strict=True)}, own={})


def _alike(rows: np.ndarray, lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Rows by length, in groups of bounded places when padded."""
    rows = rows[np.argsort(lengths[rows], kind="stable")]
    at = 0
    while at < len(rows):
        upto = at + 1
        while upto < len(rows) and (upto - at + 1) * lengths[rows[upto]] <= PLACES:
            upto += 1
        yield rows[at:upto]
        at = upto


def _taught(net: CharCnn, found: list[Finding], weight: np.ndarray, seed: int) -> CharCnn:
    """The network after one pass over ``found``, by Adam."""
    tokens = [f.token.encode("ascii") for f in found]
    lengths = np.array([len(t) for t in tokens])
    around = _around_codes([f.around for f in found])
    y = np.array([f.kind is not None for f in found], np.float32)
    weight = weight.astype(np.float32)
    values = _flat(net).astype(np.float32)
    first, second = np.zeros((2, len(values)), np.float32)
    order = np.random.default_rng(seed).permutation(len(found))
    for step, i in enumerate(range(0, len(order), BATCH), 1):
        batch = order[i : i + BATCH]
        now, grad = _shaped(net, values), 1e-4 * values
        for b in _alike(batch, lengths):
            codes, n = _codes([tokens[k] for k in b])
            logits, kept = _logits(now, codes, n, around[b])
            pull = weight[b] * (_sigmoid(logits) - y[b]) / np.float32(len(batch))
            grads = _gradients(now, codes, n, around[b], pull, kept)
            grad += np.concatenate([grads[k].ravel() for k in NAMES])
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        values = values - np.float32(5e-3) * (first / np.float32(1 - 0.9**step)) / (np.sqrt(second / np.float32(1 - 0.999**step)) + np.float32(1e-8))
    return _shaped(net, values.astype(float))


def _judged(net: CharCnn, found: list[Finding], single: bool = True) -> np.ndarray:
    """Logits, of the largest part of a token and what stands around it."""
    if not found:
        return np.zeros(0)
    net = replace(net, **{k: getattr(net, k).astype(np.float32) for k in NAMES}, own={}) if single else net
    say = [_around(net, _around_codes([f.around for f in found[i : i + 2048]]))[0] for i in range(0, len(found), 2048)]
    return net.token_logits([f.token for f in found]) + np.concatenate(say)


@dataclass(frozen=True)
class Cell:
    """The rows of a cell, with copies restyled: of rules, of no rule, and the halves that they belong to."""

    rules: list[Finding]
    copies: list[int]
    others: list[Finding]
    halves: tuple[np.ndarray, np.ndarray]

    def half(self, part: int) -> tuple[list[Finding], list[Finding]]:
        return tuple([f for f, h in zip(rows, halves, strict=True) if h == part] for rows, halves in zip((self.rules, self.others), self.halves, strict=True))


def _cell(rows: pa.Table) -> Cell:
    """Every copy but each fourth is restyled; half of the copies have nothing around, others what stands around other tokens.

    Of held-out rows the first copy is the finding itself.
    """
    rows = sorted(zip(*(rows[k].to_pylist() for k in ("key", "token", "copy", "kind", "around", "held")), strict=True), key=lambda r: (r[:3], r[3] or ""))
    others = [Finding(t, a, None) for _, t, _, kind, a, _ in rows if kind is None]
    rules, copies = [], []
    for key, token, copy, kind, around, held in rows:
        if kind is None:
            continue
        rng = random.Random(key)
        if copy if held else copy % 4:
            token = restyled(token, rng)
            if rng.random() < 0.5 and others:
                around = rng.choice(others).around
        if rng.random() < 0.5 and not (held and copy == 0):
            around = NOTHING
        rules.append(Finding(token, around, kind))
        copies.append(copy)
    half = lambda of_rule: np.array([key >> 40 & 1 for key, _, _, kind, _, _ in rows if (kind is not None) == of_rule], int)
    return Cell(rules, copies, others, (half(True), half(False)))


@dataclass(frozen=True)
class Weights:
    """Weights of a rule's rows, of other candidates by group, and of made names: both classes are equal, groups weigh as the roots of their counts."""

    rule: float
    others: tuple[float, ...]
    names: float

    @staticmethod
    def of(rules: int, others: list[int], names: int) -> Weights:
        rows = rules + sum(others) + names
        share = 1 / 3 if names else 1.0  # of the others among the negatives
        roots = sum(n**0.5 for n in others)
        return Weights(0.5 * rows / rules, tuple(0.5 * rows * share / roots / max(n, 1) ** 0.5 for n in others), 0.5 * rows * (1 - share) / max(names, 1))

    def __call__(self, rules: list[Finding], others: list[Finding], names: list[Finding]) -> np.ndarray:
        return np.array([self.rule] * len(rules) + [self.others[_group(f.token)] for f in others] + [self.names] * len(names))


def _averaged(nets: list[CharCnn], cells: GroupedData, lesson: Callable[[list[CharCnn], Cell, int], list[CharCnn | None]]) -> list[CharCnn]:
    """The networks after ``lesson(nets, cell, its number)`` in every cell, weights averaged over the cells that teach (null: it does not)."""
    size = len(_flat(nets[0]))

    def taught(key: tuple, rows: pa.Table) -> pa.Table:
        out = [(i, net) for i, net in enumerate(lesson(nets, _cell(rows), key[0].as_py())) if net is not None]
        place = [np.arange(size + 1) + i * (size + 1) for i, _ in out]
        value = [np.append(np.rint(_flat(net) / WEIGHT_STEP).astype(np.int64), 1) for _, net in out]
        empty = np.zeros(0, np.int64)
        return pa.table({"place": np.concatenate([empty, *place]), "value": np.concatenate([empty, *value])})

    sums = np.zeros((len(nets), size + 1))
    for r in cells.applyInArrow(taught, "place long, value long").groupBy("place").agg(F.sum("value").alias("value")).collect():
        sums[divmod(r["place"], size + 1)] = r["value"]
    return [_shaped(net, s[:-1] * WEIGHT_STEP / s[-1]) if s[-1] else net for net, s in zip(nets, sums, strict=True)]


def _told(cells: GroupedData, logits: Callable[[Cell], tuple[list[int], np.ndarray]]) -> dict[int, dict[int, int]]:
    """How many rows have which logit, in whole steps, by the class that ``logits(cell)`` gives with each."""

    def judged(_: tuple, rows: pa.Table) -> pa.Table:
        kinds, values = logits(_cell(rows))
        return pa.table({"class": pa.array(kinds, pa.int64()), "step": np.floor(np.clip(values, -60, 60) / LOGIT_STEP).astype(np.int64)})

    counts: dict[int, dict[int, int]] = {}
    for r in cells.applyInArrow(judged, "class long, step long").groupBy("class", "step").count().collect():
        counts.setdefault(r["class"], {})[r["step"]] = r["count"]
    return counts


def _level(steps: dict[int, int], below: float) -> int:
    """The step of the row that has this share of all rows before it."""
    left = int(below * sum(steps.values()))
    for step in sorted(steps):
        left -= steps[step]
        if left < 0:
            return step
    raise ValueError("no rows")


def _plus(*many: dict[int, int]) -> dict[int, int]:
    total: dict[int, int] = {}
    for steps in many:
        for step, n in steps.items():
            total[step] = total.get(step, 0) + n
    return total


def _distinct(docs: DataFrame) -> DataFrame:
    """token, kind, around, key, held: every finding of all texts once, with what stands around it in the text of the smallest hash."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_kind: dict[str | None, dict[str, tuple[int, bytes]]] = {kind: {} for kind in (*KINDS, None)}
            for h, text in sorted(zip(batch["h"].to_pylist(), batch["text"].to_pylist(), strict=True)):
                for token, around, kind in findings(text, by_kind[None]):
                    by_kind[kind].setdefault(token, (h, around))
            rows = [(token, kind, h, around) for kind, seen in by_kind.items() for token, (h, around) in seen.items()]
            columns = zip(*rows, strict=True) if rows else [()] * 4
            types = {"token": pa.string(), "kind": pa.string(), "h": pa.int64(), "around": pa.binary()}
            yield pa.RecordBatch.from_pydict({name: pa.array(c, t) for c, (name, t) in zip(columns, types.items(), strict=True)})

    texts = docs.where(F.col("text").isNotNull()).select("text", F.xxhash64("text").alias("h"))
    found = texts.mapInArrow(listed, "token string, kind string, h long, around binary")
    found = found.groupBy("token", "kind").agg(F.min(F.struct("h", "around"))["around"].alias("around"))
    key = F.xxhash64("token", "kind")
    held = (F.pmod(key, F.lit(3)) == 2) | F.coalesce(F.col("kind") == HELD_OUT_KIND, F.lit(False))
    digit, small = F.col("token").rlike("[0-9]"), F.col("token") == F.lower("token")
    group = F.when(digit, 2).when(small & F.col("token").rlike("[a-z]"), 0).otherwise(1)
    return found.select("*", key.alias("key"), held.alias("held"), group.alias("group"))


def _dealt(found: DataFrame, copies: int, cells: int) -> DataFrame:
    """token, around, kind, held, copy, key, cell: the rows with so many copies of each finding of a rule beside it, dealt into cells."""
    n = F.when(F.col("kind").isNull(), 0).otherwise(copies)
    rows = found.select("token", "around", "kind", "held", F.explode(F.sequence(F.lit(0), n)).alias("copy"))
    rows = rows.withColumn("key", F.xxhash64("token", "kind", "copy"))
    return rows.withColumn("cell", F.pmod("key", F.lit(cells)))


def _by_cell(rows: DataFrame, cells: int) -> GroupedData:
    """Groups for as many tasks as there are cells; a few more for few cells, lest two fall to one task.

    Cells are small in bytes and long in work, so that Spark must not coalesce them.
    """
    return rows.repartition(max(cells, min(4 * cells, 64)), "cell").groupBy("cell")


def fit(
    docs: DataFrame, recall: float = 0.99, made_recall: float = 0.98, rounds: int = 6, dim: int = 8, filters: int = 24, seed: int = 7
) -> CharCnn | None:
    """Train the CNN on all findings in all rows of ``docs(doc_id, text)``, calibrate it and set the threshold.

    Null without findings of rules or without other candidates.  Each token that a
    rule or none finds counts once.  Every third by hash is held out, and so are
    all of ``HELD_OUT_KIND``.  Each finding of a rule that teaches comes with
    restyled copies, so many that they are a quarter as many as the other candidates, at
    least three.  Unlabelled candidates are negatives, less those that a network
    trained on the other half takes for likelier than half of its positives, and so
    are names composed of their letters, half as many and of twice the weight of all.
    There are ``rounds`` rounds; a round teaches a part of the cells if there are
    more than one, so that every row is used at least once.
    The threshold is the highest that keeps ``recall`` of the held-out findings of
    the held-out kind (of all held-out ones if it has fewer than 20) and ``made_recall`` of
    restyled copies of held-out findings, rounded down to a step of the logit; ``passed`` of the
    model says which share of the held-out unlabelled candidates reaches it.
    """
    found = stored(_distinct(docs), "secret-findings")
    try:
        return _fitted(found, recall, made_recall, rounds, dim, filters, seed)
    finally:
        discard(found)


def _fitted(found: DataFrame, recall: float, made_recall: float, rounds: int, dim: int, filters: int, seed: int) -> CharCnn | None:
    counted = {(r["kind"], r["held"], r["group"]): r["count"] for r in found.groupBy("kind", "held", "group").count().collect()}
    count = lambda rule, held, groups=(0, 1, 2): sum(n for (k, h, g), n in counted.items() if (k is not None) == rule and h == held and g in groups)
    rules, others, own = count(True, False), [count(False, False, (g,)) for g in range(3)], count(True, True)
    if not rules or not sum(others) or not count(False, True):
        return None
    special = sum(n for (k, h, _), n in counted.items() if k == HELD_OUT_KIND and h)

    copies = max(3, -(-sum(others) // (4 * rules)) - 1)
    positives = rules * (1 + copies)
    cells = -(-(sum(others) + positives) // CELL)
    taught = found.where(~F.col("held"))

    def slices(n: int, times: int) -> Iterator[tuple[int, GroupedData]]:
        """So many rounds, each with its part of about ``n`` cells."""
        parts = min(times, n)
        each = -(-n // parts)
        rows = _dealt(taught, copies, parts * each)
        for i in range(times):
            yield i, _by_cell(rows.where(F.col("cell") % parts == i % parts), each)

    halves = [_start(dim, filters // 2, seed), _start(dim, filters // 2, seed + 1)]  # judges may be coarser
    weights = Weights.of(positives, others, 0)
    for i, part in slices(-(-cells // 2), max(1, rounds // 2)):

        def lesson(nets: list[CharCnn], cell: Cell, at: int, i: int = i) -> list[CharCnn | None]:
            out = []
            for h, net in enumerate(nets):
                yes, no = cell.half(h)
                out.append(_taught(net, yes + no, weights(yes, no, []), at * rounds + i) if yes or no else None)
            return out

        halves = _averaged(halves, part, lesson)

    def other_half(cell: Cell) -> tuple[list[int], np.ndarray]:
        mine = [cell.half(1 - h)[0] for h in (0, 1)]
        return [h for h in (0, 1) for _ in mine[h]], np.concatenate([_judged(net, rows) for net, rows in zip(halves, mine, strict=True)])

    steps = _told(_by_cell(_dealt(taught.where(F.col("kind").isNotNull()), copies, cells), cells), other_half)
    bars = [_level(steps[h], 0.5) * LOGIT_STEP if h in steps else np.inf for h in (0, 1)]
    weights = Weights.of(positives, others, max(1, sum(others) // 2))
    net = _start(dim, filters, seed + 2)
    for i, part in slices(cells, rounds):

        def lesson(nets: list[CharCnn], cell: Cell, at: int, i: int = i) -> list[CharCnn | None]:
            plain = []
            for h in (0, 1):
                rows = cell.half(1 - h)[1]
                plain += [f for f, x in zip(rows, _judged(halves[h], rows), strict=True) if x < bars[h]]
            rng = random.Random(at)
            words = [f.token for f in plain if f.token.isalpha()]
            names = [Finding(composed(words, rng), NOTHING if rng.random() < 0.5 else rng.choice(plain).around, None) for _ in range(len(plain) + 1 >> 1 if words else 0)]
            rows = cell.rules + plain + names
            return [_taught(nets[0], rows, weights(cell.rules, plain, names), at * rounds + i) if rows else None]

        [net] = _averaged([net], part, lesson)

    def held_out(cell: Cell) -> tuple[list[int], np.ndarray]:
        kinds = [3 if c else 1 if f.kind == HELD_OUT_KIND else 2 for f, c in zip(cell.rules, cell.copies, strict=True)]
        return [0] * len(cell.others) + kinds, _judged(net, cell.others + cell.rules, single=False)

    # without a held-out finding those that taught are asked
    held = found.where(F.col("held") | F.lit(not own) & F.col("kind").isNotNull()).withColumn("held", F.lit(True))
    many = max(3, min(40, 2000 // (own or rules)))
    cells = -(-(count(False, True) + (own or rules) * (1 + many)) // CELL)
    steps = _told(_by_cell(_dealt(held, many, cells), cells), held_out)
    sure = [steps[1] if special >= 20 else _plus(steps.get(1, {}), steps.get(2, {})), steps[3]]
    level = min(_level(x, 1 - r) for r, x in zip((recall, made_recall), sure, strict=True))
    reached = lambda x: sum(n for step, n in x.items() if step >= level) / sum(x.values())
    known, unknown = _plus(*sure), steps[0]
    logits = (np.array([*known, *unknown]) + 0.5) * LOGIT_STEP
    slope, shift = _calibrated(logits, np.repeat([1.0, 0.0], [len(known), len(unknown)]), np.array([*known.values(), *unknown.values()], float))
    threshold = float(_sigmoid(slope * level * LOGIT_STEP + shift))
    return replace(net, slope=slope, shift=shift, threshold=threshold, recall=min(map(reached, sure)), passed=reached(unknown), own={})


def _chunks(texts: pa.Array) -> Iterator[list[tuple[int, str, list[str]]]]:
    """Number, text and candidates of every text, so many at a time that they have ``MANY`` candidates, whose tokens are judged at once."""
    chunk, size = [], 0
    for i, t in enumerate(texts):
        text = t.as_py() or ""
        chunk.append((i, text, candidates(text)))
        size += len(chunk[-1][2])
        if size >= MANY:
            yield chunk
            chunk, size = [], 0
    yield chunk


def scan(text: Column, model: CharCnn | None) -> Column:
    """Spans (kind, start, end, score) of secrets in a text column, by start, then kind.

    Offsets count code points, ends are exclusive.  Rule spans have score 1; a
    candidate that meets none of them is added as kind ``cnn`` if the model's
    score reaches its threshold.  A null text is empty, repeated rows get equal
    spans, an empty table none.  Whole texts and whole candidates are read,
    whatever their length.
    """

    @F.arrow_udf(SPANS)
    def spans(texts: pa.Array) -> pa.Array:
        rows, tokens, around, owners = [], [], [], []
        least = model.least_logit() if model is not None else np.inf
        for chunk in _chunks(texts):
            bases = [base_spans(text) for _, text, _ in chunk]
            rows += [[{"kind": k, "start": s, "end": e, "score": 1.0} for s, e, k in base] for base in bases]
            if model is None:
                continue
            seen = set().union(*(found for _, _, found in chunk))
            known = model.known_logits(seen)
            likely = {w for w in seen if known[w] >= least}
            for (i, text, found), base in zip(chunk, bases, strict=True):
                if likely.isdisjoint(found):
                    continue
                met = Overlap(base)
                for m in CANDIDATE.finditer(text):
                    if m[0] in likely and not met(*m.span()):
                        tokens.append(m[0])
                        around.append(surroundings(text, *m.span()))
                        owners.append((i, *m.span()))
        for (i, s, e), score in zip(owners, model.scores(tokens, around) if tokens else (), strict=True):
            if score >= model.threshold:
                rows[i].append({"kind": "cnn", "start": s, "end": e, "score": float(score)})
        for r in rows:
            r.sort(key=lambda x: (x["start"], KINDS.index(x["kind"])))
        return pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))

    return spans(text)


def redact(docs: DataFrame, model: CharCnn | None) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``[SECRET]``; other columns stay.

    Overlapping spans are replaced as one.  ``n_chars``, where there is such a
    column, follows the new text; a null text stays null.
    """
    joined = F.aggregate(
        F.transform("__spans", lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"))),
        F.array().cast("array<struct<a:int,b:int>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["b"] > s["a"]),
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], s["b"]).alias("b"))),
            ),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    pieces = F.aggregate(
        joined,
        F.struct(F.lit("").alias("text"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(
            F.concat(acc["text"], F.substring("text", acc["at"] + 1, s["a"] - acc["at"]), F.lit(REDACTED)).alias("text"),
            s["b"].alias("at"),
        ),
        lambda acc: F.concat(acc["text"], F.substring("text", acc["at"] + 1, F.length("text"))),
    )
    out = docs.withColumn("__spans", scan(F.col("text"), model)).withColumn(
        "text", F.when(F.size("__spans") > 0, pieces).otherwise(F.col("text"))
    )
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("__spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.drop("__spans")
