"""Plain versions of the operators, straight from their contracts."""

from __future__ import annotations

import collections
import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def corpus(seed: int = 1, n: int = 40) -> list[tuple[int, str | None]]:
    """Documents with shared passages, copies, near copies, repeated lines, empty and missing texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    say = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage, line = say(120), say(9)
    docs: list[tuple[int, str | None]] = []
    for i in range(n):
        text = say(rng.randint(1, 250))
        if i % 5 == 1:
            words = text.split()
            at = rng.randint(0, len(words))
            text = " ".join(words[:at] + passage.split()[rng.randint(0, 30) :] + words[at:])
        if i % 7 == 2 and docs[-1][1]:
            words = docs[-1][1].split()
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        if i % 11 == 3:
            text = docs[-2][1] or ""
        if i % 6 == 4:
            text = f"{line}\n{text}\n{line}\n\n{line}"
        docs.append((i * 3, text))
    docs += [(500, None), (501, ""), (502, " \t\n "), (503, "one two"), (504, "one two"), (505, "na " * 300), (506, "Straße x y " * 40)]
    rng.shuffle(docs)
    return docs


def words_cut(docs, width: int) -> dict:
    least: dict = {}
    for i, t in docs:
        w = WORD.findall(t or "")
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            least[key] = min(i, least.get(key, i))
    out = {}
    for i, t in docs:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if least[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        kept = [x for x, g in zip(w, gone) if not g]
        out[i] = (len(w), sum(gone), sha(" ".join(kept)))
    return out


def bytes_cut(docs, width: int) -> dict:
    seen = collections.Counter()
    for _, t in docs:
        b = (t or "").encode()
        seen.update(b[k : k + width] for k in range(len(b) - width + 1))
    out = {}
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if seen[b[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(x for x, g in zip(b, gone) if not g)))
    return out


def near_components(docs) -> dict:
    sets = {}
    for i, t in docs:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def edit_distance_within(item: list[str], words: list[str]) -> int:
    """Least word edit distance of item to any stretch of words."""
    row = [0] * (len(words) + 1)
    for i, x in enumerate(item, 1):
        before, row = row, [i]
        for j, y in enumerate(words, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return min(row)


VALUE = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")


def secret_spans(text: str) -> list[tuple[int, int, str]]:
    """The base kinds of secrets, character by character."""
    low = "".join(c.lower() if c < "\x80" else c for c in text)
    out, at = [], 0
    while at < len(text):
        word = next((k for k in KEYWORDS if low.startswith(k, at)), None)
        end = None
        if word:
            i = at + len(word)
            i += text[i : i + 1] in ("'", '"') and i < len(text)
            while text[i : i + 1] == " ":
                i += 1
            if text[i : i + 1] in (":", "=") and i < len(text):
                i += 1
                while text[i : i + 1] == " ":
                    i += 1
                i += text[i : i + 1] in ("'", '"') and i < len(text)
                start = i
                while i < len(text) and text[i] in VALUE:
                    i += 1
                if i > start:
                    end = i
                    if i - start >= 8:
                        out.append((at, i, "assign"))
        at = end or at + 1
    at = 0
    while (at := text.find("AKIA", at)) >= 0:
        i = at + 4
        while i < len(text) and (text[i] in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" or text[i] in "0123456789"):
            i += 1
        if i - at >= 16:
            out.append((at, i, "access"))
        at = i
    start = None
    for i, c in enumerate(text + " "):
        if c in "0123456789abcdef":
            start = i if start is None else start
        else:
            if start is not None and i - start >= 32:
                out.append((start, i, "hex"))
            start = None
    return out
