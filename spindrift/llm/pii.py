"""Personal data: four exact patterns, and spans that a linear-chain CRF over word shapes adds to them.

The CRF is trained on a small labelled table (`labelled_table`), by gradient ascent on the regularised likelihood. It
labels the tokens of a text (runs of anything but white space) as none, secret, account or contact. Viterbi runs in
numpy over batches of segments of equal length. A token without digits, @ or _ cannot get a label: training checks
that for such tokens "none" beats every label by more than any change of the transitions beside it could make up for
(`Crf.margin`), so those tokens cut a text into segments that are decoded apart, with the result of one pass over all
tokens. Where the margin does not hold, whole texts are decoded.

Null texts count as empty and have no spans. Repeated rows and ties give equal results: a row's spans depend on its
text alone, and among equal paths the one with the earlier label wins. An empty table gives an empty one; other
columns are neither read nor returned. Work grows in proportion to a text's length.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, small_batches

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", "secret", "account", "contact")
ORDER = {kind: i for i, kind in enumerate((*KINDS, *LABELS[1:]))}
Span = tuple[int, int, str]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# No match of the patterns below can begin inside a run of digits, so a lookbehind spares the tries there.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> list[Span]:
    """Matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, from each @ outwards, in linear time."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at)):
            found.append((begin, m.end(), "email"))
            done = m.end()
        else:
            done = at + 1  # nothing later begins before this @
        at = text.find("@", done)
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The spans of the four patterns, by start, then kind."""
    found = emails(text)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
                found.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                found.append((m.start(), m.end(), "card"))
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], ORDER[s[2]]))


# ---- features

_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_MARKED_TAIL = re.compile(r"[0-9@_][^\x20\x09-\x0D]*")
_MARKED = re.compile(r"[0-9@_]")
_SPACE = frozenset(" \t\n\r\x0b\f")
_SHAPE = {**dict.fromkeys(range(65, 91), "X"), **dict.fromkeys(range(97, 123), "x"), **dict.fromkeys(range(48, 58), "d")}
_RUN = re.compile(r"(.)\1+", re.S)
_HEX = re.compile(r"[0-9a-f]{16,}|[0-9A-F]{16,}")
_EDGE = "\"'`.,;:()[]{}<>!?#*$%&|="
_CUES = {"token": "secret", "secret": "secret", "password": "secret", "passwd": "secret", "key": "secret", "api_key": "secret", "apikey": "secret", "bearer": "secret", "ssn": "account", "iban": "account", "account": "account", "passport": "account", "phone": "contact", "tel": "contact", "call": "contact", "fax": "contact", "mobile": "contact"}


@functools.lru_cache(8192)
def _own(token: str) -> tuple[str, ...]:
    """What a token says of itself: its shape, runs and lengths."""
    core = token.strip(_EDGE)
    shape = _RUN.sub(r"\1", core.translate(_SHAPE) if core.isascii() else "".join(_SHAPE.get(ord(c), "x" if c.isalpha() else c) for c in core))
    digits = sum(c.isdigit() for c in core)
    out = ["bias", f"shape={shape[:12]}", f"length={min(len(core), 48) // 4}"]
    if not _MARKED.search(token):
        return ("bias", "plain")
    out.append(f"digits={min(digits, 20) // 3}")
    if _HEX.fullmatch(core):
        out.append("hex")
    if len(core) >= 16 and "X" in shape and "x" in shape and "d" in shape:
        out.append("mixed")
    return tuple(out)


def _cue(token: str) -> str:
    return _CUES.get(token.strip(_EDGE).lower(), "")


def features(tokens: list[str], i: int) -> list[str]:
    """Of token i: itself, whether its neighbours are plain, and the cues of the two tokens before it."""
    out = list(_own(tokens[i]))
    plain = out[1] == "plain"
    for step, name in ((-1, "before"), (1, "after")):
        j = i + step
        there = 0 <= j < len(tokens)
        out.append(f"{name}={'edge' if not there else 'marked' if _MARKED.search(tokens[j]) else 'plain'}|{plain}")
    for step in (1, 2):
        if i >= step and (cue := _cue(tokens[i - step])):
            out.append(f"cue={cue}|{plain}")
            break
    return out


# ---- the model

@dataclass(frozen=True)
class Crf:
    index: dict[str, int]
    weights: np.ndarray  # features x labels
    moves: np.ndarray  # label x next label; a text begins and ends beside "none"
    margin: float  # by how much "none" beats each label at least on a token without digits, @ and _; negative: it may not

    def emission(self, names: list[str]) -> np.ndarray:
        out = np.zeros(len(LABELS))
        for name in names:
            if (k := self.index.get(name)) is not None:
                out += self.weights[k]
        return out

    def viterbi(self, emissions: np.ndarray) -> np.ndarray:
        """The best paths of segments of equal length: segments x tokens x labels to segments x tokens."""
        score = emissions[:, 0] + self.moves[0]
        back = []
        for t in range(1, emissions.shape[1]):
            every = score[:, :, None] + self.moves
            back.append(every.argmax(1))
            score = every.max(1) + emissions[:, t]
        path = [(score + self.moves[:, 0]).argmax(1)]
        for best in reversed(back):
            path.append(np.take_along_axis(best, path[-1][:, None], 1)[:, 0])
        return np.stack(path[::-1], 1)


def labelled_table(seed: int = 7, rows: int = 240) -> list[list[tuple[str, str]]]:
    """The table that the CRF learns from: sentences as (token, label), made from templates."""
    rng = random.Random(seed)
    words = "the of and a to in is was for with please use set send reach when about meeting report page chapter version total price order room note from that this near our".split()
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    mixed = lambda n: "".join(rng.choice("abcdefghijkABCDEFGHIJK0123456789") for _ in range(n - 3)) + "aB7"
    quoted = lambda s: rng.choice((s, f'"{s}"', f"{s}.", f"{s},", f"'{s}'", f"{s}###"))
    secret = lambda: rng.choice((hexes(32), hexes(40), hexes(64), mixed(20), mixed(32), f"sk_{mixed(24)}", f"password={hexes(18)}", f"token={hexes(32)}", f"key={mixed(20)}"))
    account = lambda: rng.choice((f"{number(3)}-{number(2)}-{number(4)}", f"DE{number(20)}", f"FR{number(14)}", f"ES{number(22)}", number(12)))
    contact = lambda: rng.choice(([f"({number(3)})", f"{number(3)}-{number(4)}"], [f"{number(3)}-{number(3)}-{number(4)}"], [f"{number(3)}.{number(3)}.{number(4)}"], [f"{rng.choice(words)}_{rng.choice(words)}@host"]))
    plain = lambda: [(rng.choice(words), "none") for _ in range(rng.randint(1, 4))]
    ordinary = lambda: [(quoted(rng.choice((number(1), number(2), number(4), f"{number(1)}.{number(1)}", f"{number(2)}%", f"{number(2)},{number(3)}", f"v{number(1)}.{number(1)}", f"{number(4)}-{number(2)}-{number(2)}", f"{number(2)}:{number(2)}", f"item_{number(2)}", f"x{number(2)}", f"@{rng.choice(words)}", f"{rng.choice(words)}_{rng.choice(words)}", f"${number(3)}"))), "none")]
    table = []
    for i in range(rows):
        line = plain()
        if i % 4 == 0:
            cue = rng.choice(("token", "key", "password", "secret", "bearer", "api_key:"))
            line += [(cue, "none")] + ([("=", "none")] if rng.random() < 0.6 else []) + [(quoted(secret()), "secret")]
        elif i % 4 == 1:
            line += [(rng.choice(("ssn", "iban", "account", "passport")), "none"), (quoted(account()), "account")]
        elif i % 4 == 2:
            line += [(rng.choice(("call", "phone", "tel", "mobile", "fax:")), "none")] + [(token, "contact") for token in contact()]
        else:
            line += ordinary() + plain() + ordinary()
            if rng.random() < 0.4:
                line += [(rng.choice(("token", "key", "call", "account", "password")), "none")] + plain()
        table.append(line + (ordinary() if rng.random() < 0.4 else []) + plain())
    return table


def _cell(spans: np.ndarray) -> np.ndarray:
    m = spans.max(-1, keepdims=True)
    return (m + np.log(np.exp(spans - m).sum(-1, keepdims=True)))[..., 0]


@functools.lru_cache(4)
def fit(seed: int = 7, rounds: int = 220, ridge: float = 0.02, rate: float = 0.15) -> Crf:
    """Trains the CRF on the labelled table: log-likelihood less a ridge, by Adam, forward and backward in numpy."""
    table = labelled_table(seed)
    index: dict[str, int] = {}
    rows = [[[index.setdefault(name, len(index)) for name in features([t for t, _ in line], i)] for i in range(len(line))] for line in table]
    n, longest, s = len(table), max(map(len, table)), len(LABELS)
    design = np.zeros((n, longest, len(index)))
    gold = np.zeros((n, longest), int)
    mask = np.zeros((n, longest), bool)
    for i, line in enumerate(table):
        for t, (_, label) in enumerate(line):
            design[i, t, rows[i][t]] = 1
            gold[i, t], mask[i, t] = LABELS.index(label), True
    onehot = np.eye(s)[gold] * mask[..., None]
    steps = np.zeros((s, s))
    for i, line in enumerate(table):
        path = [0, *gold[i, : len(line)], 0]
        np.add.at(steps, (path[:-1], path[1:]), 1)
    weights, moves = np.zeros((len(index), s)), np.zeros((s, s))
    moment = [np.zeros_like(x) for x in (weights, moves, weights, moves)]
    ends = mask.sum(1) - 1
    for k in range(1, rounds + 1):
        e = design @ weights
        alpha, beta = np.zeros((n, longest, s)), np.zeros((n, longest, s))
        alpha[:, 0] = e[:, 0] + moves[0]
        for t in range(1, longest):
            new = _cell((alpha[:, t - 1][:, :, None] + moves).transpose(0, 2, 1)) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
        total = _cell(alpha[:, -1] + moves[:, 0])
        beta[:, -1] = moves[:, 0]
        for t in range(longest - 2, -1, -1):
            new = _cell(moves[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :])
            beta[:, t] = np.where((t < ends)[:, None], new, moves[:, 0])
        marginal = np.exp(alpha + beta - total[:, None, None]) * mask[..., None]
        pairs = np.zeros((s, s))
        for t in range(1, longest):
            both = alpha[:, t - 1][:, :, None] + moves + (e[:, t] + beta[:, t])[:, None, :] - total[:, None, None]
            pairs += (np.exp(both) * mask[:, t, None, None]).sum(0)
        pairs[0] += marginal[:, 0].sum(0)
        pairs[:, 0] += marginal[np.arange(n), ends].sum(0)
        grads = (np.einsum("ntf,nts->fs", design, onehot - marginal) / n - ridge * weights / n, (steps - pairs) / n - ridge * moves / n)
        for j, (x, g) in enumerate(zip((weights, moves), grads, strict=True)):
            moment[j] = 0.9 * moment[j] + 0.1 * g
            moment[j + 2] = 0.99 * moment[j + 2] + 0.01 * g * g
            x += rate * (moment[j] / (1 - 0.9**k)) / (np.sqrt(moment[j + 2] / (1 - 0.99**k)) + 1e-8)
    return Crf(index, weights, moves, _margin(index, weights, moves))


def _margin(index: dict[str, int], weights: np.ndarray, moves: np.ndarray) -> float:
    """The least lead of "none" on a token without digits, @ and _, less what the moves beside it could give back."""
    lead = weights[:, :1] - weights
    of = lambda name: lead[index[name]] if name in index else np.zeros(len(LABELS))
    least = lambda names, also=(): np.min([of(x) for x in names] + list(also), axis=0)
    worst = of("bias") + of("plain")
    for side in ("before", "after"):
        worst = worst + least([f"{side}={x}|True" for x in ("edge", "marked", "plain")])
    worst = worst + least([f"cue={x}|True" for x in sorted(set(_CUES.values()))], [np.zeros(len(LABELS))])
    gain = (moves - moves[:, :1]).max(0) + (moves - moves[:1]).max(1)
    return float((worst - gain)[1:].min())


# ---- spans

def _segments(text: str, whole: bool) -> list[list[tuple[int, int]]]:
    """Runs of neighbouring tokens with a digit, @ or _; or one run of all tokens."""
    if whole:
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        return [tokens] if tokens else []
    out: list[list[tuple[int, int]]] = []
    done = -1
    for m in _MARKED_TAIL.finditer(text):
        begin = m.start()
        while begin > max(done, 0) and text[begin - 1] not in _SPACE:
            begin -= 1
        if out and not text[done:begin].strip(" \t\n\r\x0b\f"):
            out[-1].append((begin, m.end()))
        else:
            out.append([(begin, m.end())])
        done = m.end()
    return out


def _beside(text: str, begin: int, end: int) -> tuple[list[str], list[str]]:
    """The two tokens before `begin`, however far away, and the one after `end`; of a long one, its beginning."""
    room = 80
    while True:
        low = max(0, begin - room)
        before = _TOKEN.findall(text[low:begin])
        cut = low and text[low] not in _SPACE and text[low - 1] not in _SPACE  # the first one may be a part of a token
        if not low or len(before) - bool(cut) >= 2:
            break
        room *= 8
    after = _TOKEN.search(text, end)
    return before[-2:], [after[0][:40]] if after else []


def added_spans(texts: list[str], crf: Crf) -> list[list[Span]]:
    """What the CRF finds in each text; neighbouring tokens of one label are one span, without punctuation at its ends."""
    whole = crf.margin <= 0
    groups: dict[int, list[tuple[int, list[tuple[int, int]], np.ndarray]]] = defaultdict(list)
    remembered: dict[tuple[str, ...], np.ndarray] = {}
    for k, text in enumerate(texts):
        for run in _segments(text, whole):
            before, after = ([], []) if whole else _beside(text, run[0][0], run[-1][1])
            tokens = before + [text[a:b] for a, b in run] + after
            rows = []
            for i in range(len(before), len(before) + len(run)):
                names = tuple(features(tokens, i))
                if names not in remembered:
                    remembered[names] = crf.emission(names)
                rows.append(remembered[names])
            groups[len(run)].append((k, run, np.array(rows)))
    found: list[list[Span]] = [[] for _ in texts]
    for members in groups.values():
        paths = crf.viterbi(np.stack([x[2] for x in members]))
        for (k, run, _), path in zip(members, paths, strict=True):
            if not path.any():
                continue
            i = 0
            while i < len(run):
                j = i
                while j + 1 < len(run) and path[j + 1] == path[i]:
                    j += 1
                if path[i]:
                    begin, end = run[i][0], run[j][1]
                    core = texts[k][begin:end]
                    begin += len(core) - len(core.lstrip(_EDGE))
                    end -= len(core) - len(core.rstrip(_EDGE))
                    if begin < end:
                        found[k].append((begin, end, LABELS[path[i]]))
                i = j + 1
    return [sorted(spans) for spans in found]


def all_spans(texts: list[str], crf: Crf) -> list[tuple[list[Span], list[Span]]]:
    """Of each text the base spans, and these with the added ones that overlap none of them."""
    out = []
    for text, added in zip(texts, added_spans(texts, crf), strict=True):
        base = base_spans(text)
        more = [s for s in added if not any(s[0] < b and a < s[1] for a, b, _ in base)] if base else added
        out.append((base, sorted(base + more, key=lambda s: (s[0], ORDER[s[2]])) if more else base))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


#: Texts that are decoded together hold so many characters, or are one.
BATCH_CHARS = 4_000_000


def _together(texts):
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= BATCH_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def detector(crf: Crf | None = None):
    """A function of a text column that gives FOUND."""
    crf = crf or fit()

    def apply(batches):
        for batch in batches:
            rows = []
            for texts in _together(x or "" for x in batch):
                for base, spans in all_spans(texts, crf):
                    kinds = [kind for _, _, kind in base]
                    rows.append((*(kinds.count(kind) for kind in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in FOUND.split(", ")])

    return _series_udf(apply, FOUND)


def redactor(crf: Crf | None = None):
    """A function of a text column that puts [KIND] in place of each span; null stays null."""
    crf = crf or fit()

    def apply(batches):
        for batch in batches:
            out = []
            for texts in _together(x or "" for x in batch):
                out += [redact(text, spans) for text, (_, spans) in zip(texts, all_spans(texts, crf), strict=True)]
            yield pd.Series([None if x is None else y for x, y in zip(batch, out, strict=True)], dtype=object)

    return _series_udf(apply, "string")


def redact(text: str, spans: list[Span]) -> str:
    """Spans that overlap become one, of the first one's kind."""
    out, at, i = [], 0, 0
    while i < len(spans):
        begin, end, kind = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][1])
            i += 1
        out += [text[at:begin], f"[{kind.upper()}]"]
        at = end
    return "".join(out) + text[at:] if out else text


def _series_udf(apply, schema: str):
    apply.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series if schema == "string" else pd.DataFrame]}
    return F.pandas_udf(giving_back(apply), schema)


def find(documents: DataFrame, crf: Crf | None = None) -> DataFrame:
    """doc_id and FOUND of every document."""
    f = detector(crf)
    return small_batches(documents).select("doc_id", f(F.col("text").cast("string")).alias("r")).select("doc_id", "r.*")


def mask(documents: DataFrame, crf: Crf | None = None) -> DataFrame:
    """The documents with their texts redacted and, if there is such a column, n_chars counted anew."""
    out = small_batches(documents).withColumn("text", redactor(crf)(F.col("text").cast("string")))
    return out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in documents.columns else out
