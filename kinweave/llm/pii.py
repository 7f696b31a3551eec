"""Personal data: base patterns plus a skip-chain conditional random field.

Tokens with a digit, `@` or `=` are the field's variables. All other words are observed as none, which no label
of the training documents contradicts: names and addresses in words alone are not looked for. They serve as context. Each variable has unary
potentials from its shape and the words before it; neighbouring variables share a transition
potential, and each repeated or similar token (the same letters and digits, or the same value behind a `=`) shares an
agreement potential with its previous occurrence anywhere in the document, so one clear occurrence decides the
unclear ones. Loopy belief propagation gives the marginals. Links to the previous occurrence only keep the graph
linear in the document. All weights, of words, transitions and agreement, are fitted together by pseudo-likelihood to a
bounded number of documents that a seeded generator labels; pattern matches enter as near-certain evidence and always stay."""

from __future__ import annotations

import functools
import hashlib
import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.common import fresh, map_texts

KINDS = ("email", "ip", "card", "phone", "secret", "id")
#: Production parameters: training documents, message rounds, evidence of a pattern, least marginal.
TRAIN_DOCS, ROUNDS, EVIDENCE, LEAST = 2500, 6, 8.0, 0.8
#: Characters between two variables that still count as neighbours.
NEAR = 24
#: Messages computed at once: memory stays bounded in documents with many variables.
BLOCK = 1 << 16

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match begins at the first digit of its run, for a later start in the run fails alike.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Tried only where a token begins: a long token without a digit costs one pass, not one a character.
_VARIABLE = re.compile(r"(?<![^\x20\x09-\x0d])[^\x20\x09-\x0d]*[0-9@=][^\x20\x09-\x0d]*")
#: What is left of a token between its punctuation; an empty core is no variable.
_CORE = re.compile(r"[+@]?\w(?:.*\w)?", re.S)


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each `@` outwards, in linear time."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((begin, m.end()))
            end = m.end()
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)
    return out


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(int(d) * 2 - 9 * (d > "4") for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, sorted."""
    out = [(a, 0, b) for a, b in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() and 12 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


# The field

SIZE = 512


def _shape(token: str) -> str:
    return re.sub(r"(.)\1+", r"\1", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", token))))[:12]


def _slot(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=4).digest(), "little") % SIZE


_slot = functools.lru_cache(1 << 16)(_slot)


def features(token: str, before: tuple[str, str]) -> list[int]:
    """Slots of the features that are on: shape, lengths, character counts and the two words before."""
    digits, n = sum(c.isdigit() for c in token), len(token)
    key, _, value = token.rpartition("=")
    hexes = sum(c in "0123456789abcdef" for c in value)
    last, older = (w.lower().strip("\"'([{:;,.")[-12:] for w in reversed(before))
    names = [
        "bias", f"shape {_shape(token)}", f"length {min(n, 40) // 4}", f"digits {min(digits, 20)}", f"at {token.count('@')}", f"dots {min(token.count('.'), 4)}",
        f"share {4 * digits // max(n, 1)}", f"plus {token[:1] == '+'}", f"hex {len(value) >= 16 and hexes == len(value)}", f"upper {n >= 16 and token.isupper() and token.isalnum()}",
        f"luhn {12 <= digits <= 19 and digits == n and luhn(token)}", f"dashes {min(token.count('-'), 5)}", f"mixed {n >= 16 and digits > 0 and not token.islower() and not token.isupper() and '/' not in token}",
        f"key {key.lower()[-12:]}" if key else "no key", f"before {last}", f"older {older}", f"start {token[:4].lower() if token[:1].isalpha() else ''}",
        f"runs {'-'.join(str(len(r)) for r in re.findall('[0-9]+', token))[:12]}",
    ]
    return [_slot(x) for x in names]


def key_of(token: str) -> str:
    """What similar tokens share: letters and digits of the value; '' is like nothing."""
    name, _, value = token.rpartition("=")
    return re.sub(r"[^0-9A-Za-z@]", "", value or name).lower()


def generate(rng: random.Random) -> list[tuple[str, tuple[str, str], int]]:
    """Variables of a made-up document: (token, the two words before, label); label 0 is none, k + 1 is KINDS[k].

    Some tokens come again later without the words that gave them away."""
    word = lambda: "".join(rng.choice("etaoinshrdlucmbgpv") for _ in range(rng.randint(2, 9)))
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    digits = lambda n: pick("0123456789", n)
    hexes = lambda n: pick("0123456789abcdef", n)
    low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    mixed = lambda n: pick(low + up + "0123456789", n)
    key = rng.choice(["password", "passwd", "pwd", "secret", "api_key", "apikey", "token", "auth", "access_key"])
    number = rng.choice("3456") + digits(rng.choice([11, 13, 14, 14, 14]))
    check = next(d for d in range(10) if luhn(f"{number}{d}"))
    free = (word(), word())
    ids = ["ssn", "social", "passport", "iban", "tax", "insurance", "license", "licence"]
    choices = [
        (f"{word()}.{digits(2)}@{word()}.example.com", free, 1),
        (f"{word()}@{word()}.org", (word(), rng.choice(["email", "mail", word()])), 1),
        (".".join(str(rng.randint(0, 255)) for _ in range(4)), free, 2),
        (f"{number}{check}", (word(), rng.choice(["card", word()])), 3),
        (f"{number}{(check + rng.randint(1, 9)) % 10}", (word(), rng.choice(["card", "order", word()])), 0),
        (f"+{rng.randint(1, 99)}{digits(rng.randint(8, 11))}", (word(), rng.choice(["phone", "call", word()])), 4),
        (f"{digits(3)}-{digits(3)}-{digits(4)}", (word(), rng.choice(["phone", "call", "tel", "mobile"])), 4),
        ("AKIA" + pick(up + "0123456789", 16), free, 5),
        (rng.choice(["ghp_", "gho_", "sk_live_", "sk-", "xoxb-", "glpat-"]) + mixed(rng.randint(20, 40)), free, 5),
        (f"eyJ{mixed(rng.randint(15, 40))}.{mixed(rng.randint(15, 40))}.{mixed(rng.randint(20, 40))}", (word(), rng.choice(["bearer", "token", word()])), 5),
        (f"{key}={rng.choice([hexes, mixed])(rng.randint(8, 40))}", free, 5),
        (hexes(rng.choice([32, 40, 64])), (key, rng.choice(["=", "is", ":"])), 5),
        (mixed(rng.randint(10, 40)), (rng.choice([word(), key]), rng.choice([key, "="])), 5),
        (f"{digits(3)}-{digits(2)}-{digits(4)}", (word(), rng.choice([*ids, word()])), 6),
        (f"{pick(up, 2)}{digits(2)}{rng.choice([pick(up, 4), ''])}{digits(rng.randint(10, 18))}", (word(), rng.choice(["iban", "account", word()])), 6),
        (f"{pick(up, rng.randint(1, 2))}{digits(rng.randint(6, 9))}", (rng.choice([word(), *ids]), rng.choice(["passport", "number", "no"])), 6),
        (digits(rng.randint(1, 8)), free, 0),
        (f"{digits(1)}.{digits(1)}", (word(), rng.choice(["version", word()])), 0),
        (f"{digits(1)}.{digits(1)}.{digits(2)}", free, 0),
        (str(rng.randint(1900, 2099)), free, 0),
        (f"20{digits(2)}-{rng.randint(1, 12):02d}-{digits(2)}", free, 0),
        (f"{hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)}", free, 0),
        (f"http://{word()}.org/{digits(5)}", free, 0),
        (hexes(rng.choice([7, 8, 40])), (word(), rng.choice(["commit", "revision"])), 0),
        (f"{word()}={word()}", free, 0),
        (f"x{digits(2)}", free, 0),
        (f"{pick(up, 2)}-{digits(3)}", free, 0),
        (f"@{word()}", free, 0),
        (f"{digits(3)},{digits(3)}", free, 0),
    ]
    out = rng.sample(choices, rng.randint(1, 5))
    for token, _, label in rng.sample(out, rng.randint(0, len(out))):
        value = token.rpartition("=")[2]
        out.insert(rng.randint(0, len(out)), (rng.choice([token, value]), (word(), rng.choice([word(), "the", "and"])), label))
    return out


def _links(keys: list[str], near: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """Edges (i, j, potential kind): neighbours (0), and previous occurrences of the same key (1). near[j]: j follows closely on j - 1."""
    last: dict[str, int] = {}
    edges, kinds = [], []
    for j, key in enumerate(keys):
        i = last.get(key) if key else None
        if j and near[j] and i != j - 1:
            edges.append((j - 1, j))
            kinds.append(0)
        if i is not None:
            edges.append((i, j))
            kinds.append(1)
        last[key] = j
    return np.array(edges, np.int64).reshape(-1, 2), np.array(kinds, np.int64)


@functools.lru_cache(1)
def weights(seed: int = 3, docs: int = TRAIN_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """(SIZE, labels) unary weights and (2, labels, labels) of transitions and agreement.

    Full-batch gradient ascent on the pseudo-likelihood of the generator's documents: each label given
    those of its links. Half of the links are hidden, so that the unary weights don't lean on them."""
    rng = random.Random(seed)
    x, y, edges, kinds = [], [], [], []
    for _ in range(docs):
        rows = generate(rng)
        e, k = _links([key_of(t) for t, *_ in rows], [rng.random() < 0.5 for _ in rows])
        shown = np.array([rng.random() < 0.5 for _ in k], bool)
        edges.append(e[shown] + len(x))
        kinds.append(k[shown])
        x += [features(t, b) for t, b, _ in rows]
        y += [label for *_, label in rows]
    x, edges, kinds = np.array(x), np.concatenate(edges), np.concatenate(kinds)
    label, y = np.array(y), np.eye(len(KINDS) + 1)[y]
    left, right = edges.T
    w, ties = np.zeros((SIZE, y.shape[1])), np.zeros((2, y.shape[1], y.shape[1]))
    for _ in range(150):
        s = w[x].sum(axis=1)
        np.add.at(s, right, ties[kinds, label[left]])
        np.add.at(s, left, ties[kinds, :, label[right]])
        p = np.exp(s - s.max(axis=1, keepdims=True))
        g = (y - p / p.sum(axis=1, keepdims=True)) / len(x)
        step = np.stack([np.bincount(x.ravel(), np.repeat(column, x.shape[1]), SIZE) for column in g.T], axis=1)
        w += 4.0 * step - 1e-4 * w
        for k in (0, 1):
            i, j = left[kinds == k], right[kinds == k]
            move = y[i].T @ g[j] + g[i].T @ y[j]
            # Agreement has no direction.
            ties[k] += 4.0 * (move + move.T if k else move) - 1e-4 * ties[k]
    return w, ties


def marginals(unary: np.ndarray, edges: np.ndarray, kinds: np.ndarray, potentials: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Loopy sum-product over all edges at once, in logs, damped by half."""
    n, k = unary.shape
    norm = lambda x: x - np.log(np.exp(x - x.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) - x.max(axis=1, keepdims=True)
    if not len(edges):
        return np.exp(norm(unary))
    source, target = np.r_[edges[:, 0], edges[:, 1]], np.r_[edges[:, 1], edges[:, 0]]
    back = np.r_[np.arange(len(edges)) + len(edges), np.arange(len(edges))]
    # Messages against the reading direction see a potential from its other side.
    same = np.r_[kinds, kinds + 2]
    ties = np.concatenate([potentials, potentials.transpose(0, 2, 1)])
    message = np.zeros((len(source), k))
    for _ in range(rounds):
        belief = unary.copy()
        np.add.at(belief, target, message)
        sent = np.empty_like(message)
        for i in range(0, len(source), BLOCK):
            at = slice(i, i + BLOCK)
            m = (belief[source[at]] - message[back[at]])[:, :, None] + ties[same[at]]
            top = m.max(axis=1)
            sent[at] = norm(0.5 * message[at] + 0.5 * norm(top + np.log(np.exp(m - top[:, None, :]).sum(axis=1))))
        message = sent
    belief = unary.copy()
    np.add.at(belief, target, message)
    return np.exp(norm(belief))


def find(text: str | None, model: tuple[np.ndarray, np.ndarray]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), each sorted (start, kind, end)."""
    text = text or ""
    w, ties = model
    base = base_spans(text)
    tokens, spans, before = [], [], []
    for m in _VARIABLE.finditer(text):
        core = _CORE.search(m[0])
        if not core:
            continue
        a = m.start() + core.start()
        tokens.append(core[0])
        spans.append((a, a + len(core[0])))
        left = text[max(0, m.start() - 40) : m.start()].split()[-2:]
        # What stands in front of the core inside the token, a quote or a key, is punctuation.
        before.append(("", "", *left)[-2:])
    if not tokens:
        return base, base
    # Copies of one token are equal in their features but for the words before; a long document is scored in one product.
    x = np.array([features(t, b) for t, b in zip(tokens, before)])
    unary = w[x].sum(axis=1)
    starts = np.array([s for s, _ in spans])
    for a, kind, b in base:
        i, j = np.searchsorted(starts, a, "left"), np.searchsorted(starts, b, "left")
        i = i - 1 if i and spans[i - 1][1] > a else i
        unary[i:j, kind + 1] += EVIDENCE
    near = [j > 0 and spans[j][0] - spans[j - 1][1] <= NEAR for j in range(len(spans))]
    p = marginals(unary, *_links([key_of(t) for t in tokens], near), ties)
    label, sure = p.argmax(axis=1), p.max(axis=1) >= LEAST
    found = list(base)
    covered = iter(sorted((a, b) for a, _, b in base))
    now = next(covered, None)
    for (a, b), k, ok in zip(spans, label, sure):
        while now and now[1] <= a:
            now = next(covered, None)
        # Base spans stay as they are; nothing that touches one is added.
        if k and ok and not (now and now[0] < b) and b - a >= 6:
            found.append((a, int(k) - 1, b))
    return base, sorted(found)


def show(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with each span, overlapping ones as one, replaced by its first kind in angle brackets."""
    if not spans:
        return text
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, text: str = "text", keep: list[str] | None = None, redacted: bool = False) -> DataFrame:
    """Append n_email, n_ip, n_card, n_phone, base_sha256, spans and n_spans (and redacted); names that clash get a trailing _.

    Counts of kinds are those of base spans; n_spans counts all spans. Null and empty texts have none. Rows pass through one to one, repeated rows
    too; long texts are searched whole; an empty table stays empty. Weights have a fixed size."""
    keep = docs.columns if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(weights())
    names = fresh(keep, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans", "redacted")[: 8 if redacted else 7]

    def kernel():
        w = shared.value

        def work(texts):
            found = [find(t, w) for t in texts]
            counts = [[sum(k == kind for _, k, _ in base) for base, _ in found] for kind in range(4)]
            out = [*counts, [hashlib.sha256(show(b).encode()).hexdigest() for b, _ in found], [show(s) for _, s in found], [len(s) for _, s in found]]
            return out + [[redact(t, s) for t, (_, s) in zip(texts, found)]] * redacted

        return work

    types = [T.LongType()] * 4 + [T.StringType()] * 2 + [T.LongType(), T.StringType()]
    return map_texts(docs, text, [T.StructField(n, t) for n, t in zip(names, types)], kernel, keep)
