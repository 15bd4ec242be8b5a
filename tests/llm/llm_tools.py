"""Plain versions of what the queries compute, for small tables."""

import hashlib
import re
import zlib

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def bucket(doc_id, n):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


class brute:
    @staticmethod
    def base_spans(text):
        text, found = text or "", []
        for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
            if len(m[2]) >= 12:
                found.append((m.start(), 0, m.end()))
        found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
        return [f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found)]

    @staticmethod
    def rules(text):
        text = text or ""
        words = WORD.findall(text)
        windows = list(zip(words, words[1:], words[2:]))
        at = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)} if len(words) < 2000 else None
        lines = [x for x in text.split("\n") if WORD.search(x)]
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), None if at is None else len(at)

    @staticmethod
    def repeats(rows, length=50):
        """rows: (doc_id or None, text); the kept bytes and counts of each, in order."""
        first, out = {}, []
        key = lambda i: (i is None, i or 0)
        data = [(key(i), (t or "").encode()) for i, t in rows]
        for i, b in data:
            for s in range(len(b) - length + 1):
                w = b[s : s + length]
                first[w] = min(first.get(w, i), i)
        for i, b in data:
            gone = bytearray(len(b))
            for s in range(len(b) - length + 1):
                if first[b[s : s + length]] < i:
                    gone[s : s + length] = b"\x01" * length
            kept = bytes(c for c, g in zip(b, gone) if not g)
            spans = sum(1 for x in range(len(b)) if gone[x] and (x == 0 or not gone[x - 1]))
            out.append((len(b), sum(gone), spans, sha(kept)))
        return out

    @staticmethod
    def fingerprint(text, size=3):
        words = WORD.findall(lower(text))
        if not words:
            return 0
        shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    @staticmethod
    def components(ids, prints, distance=3):
        parent = list(range(len(ids)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a in range(len(ids)):
            for b in range(a):
                if (prints[a] ^ prints[b]).bit_count() <= distance:
                    parent[find(a)] = find(b)
        groups = {}
        for a in range(len(ids)):
            groups.setdefault(find(a), []).append(ids[a])
        return [min((i for i in groups[find(a)] if i is not None), default=None) for a in range(len(ids))]

    @staticmethod
    def hits(text, items, window=8):
        """(n_words, n_hit, sorted item ids as text) for items (id, text)."""
        words = ALNUM.findall(lower(text))
        hit, found = set(), set()
        for name, t in items:
            own = ALNUM.findall(lower(t))
            if name is None or not own:
                continue
            n = min(window, len(own))
            for i in range(len(own) - n + 1):
                for j in range(len(words) - n + 1):
                    if words[j : j + n] == own[i : i + n]:
                        hit.update(range(j, j + n))
                        found.add(str(name))
        return len(words), len(hit), sorted(found)
