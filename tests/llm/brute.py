"""Plain versions of the operators, written apart from them."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fingerprint(text):
    w = words((text or "").translate(LOW))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(items, linked):
    """items: list; linked(i, j). Returns the component number of each item."""
    own = list(range(len(items)))

    def root(i):
        while own[i] != i:
            i = own[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                own[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(items))]


def measures(text):
    text = text or ""
    w = words(text)
    runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if words(x)]
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_distinct": len(set(w)),
        "n_repeat_words": len(covered),
    }


def normal_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def contamination(text, items, size=10):
    """items: (id, text). Returns words, hit words, sorted ids."""
    w = normal_words(text)
    hit, names = set(), set()
    for name, body in items:
        v = normal_words(body)
        for s in range(max(1, len(v) - size + 1) if v else 0):
            run = v[s : s + size]
            for i in range(len(w) - len(run) + 1):
                if w[i : i + len(run)] == run:
                    hit.update(range(i, i + len(run)))
                    names.add(name)
    return len(w), len(hit), sorted(str(x) for x in names if x is not None)


def crc(text):
    return zlib.crc32((text or "").encode())


def patience(a, b):
    """Aligned places of two lists, by recursion."""

    def go(a0, a1, b0, b1):
        head = []
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            head.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        tail = []
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            tail.append((a1, b1))
        once = [x for x in set(a[a0:a1]) if x and a[a0:a1].count(x) == 1 and b[b0:b1].count(x) == 1]
        pairs = sorted((b.index(x, b0, b1), a.index(x, a0, a1)) for x in once)
        best = longest([i for _, i in pairs])
        middle = []
        if best:
            at = (a0, b0)
            for k in best:
                j, i = pairs[k]
                middle += [*go(at[0], i, at[1], j), (i, j)]
                at = (i + 1, j + 1)
            middle += go(at[0], a1, at[1], b1)
        return head + middle + tail[::-1]

    return go(0, len(a), 0, len(b))


def longest(values):
    """Places of the longest rising chain; of equal ones what patience sorting gives."""
    piles, last, before = [], [], []
    for n, x in enumerate(values):
        k = sum(p < x for p in piles)
        before.append(last[k - 1] if k else None)
        if k == len(piles):
            piles.append(x)
            last.append(n)
        else:
            piles[k], last[k] = x, n
    chain, n = [], last[-1] if last else None
    while n is not None:
        chain.append(n)
        n = before[n]
    return chain[::-1]


def line_dedup(docs, min_words=5):
    """docs: (id, text) with distinct ids, in order: each aligned with every earlier one. Returns the new texts."""
    split = {d: [x for x in t.split("\n")] for d, t in docs}
    lines = {d: [" ".join(words(x)) for x in v if words(x)] for d, v in split.items()}
    out = []
    for k, (d, _) in enumerate(docs):
        gone = set()
        for other, _ in docs[:k]:
            if not set(lines[other]) & set(lines[d]):
                continue
            blocks = []
            for i, j in patience(lines[other], lines[d]):
                if blocks and blocks[-1][-1] == (i - 1, j - 1):
                    blocks[-1].append((i, j))
                else:
                    blocks.append([(i, j)])
            for block in blocks:
                if sum(len(lines[d][j].split()) for _, j in block) >= min_words:
                    gone |= {j for _, j in block}
        places = iter(range(len(lines[d])))
        out.append("\n".join(x for x in split[d] if not words(x) or next(places) not in gone))
    return out


def span_dedup(docs, run=3, min_words=25, long_words=40):
    seen, out = set(), []
    for _, text in docs:
        parts = re.findall(r"[^.!?\n]+[.!?\n]*\s*|[.!?\n]+\s*", text)
        assert "".join(parts) == text
        plain = [[x for x in re.split(r"[\x20\x09-\x0D]+", p.translate(LOW)) if x] for p in parts]
        gone = set()
        for i in range(len(parts)):
            ends = [i + n for n in range(run, len(parts) - i + 1) if sum(map(len, plain[i : i + n])) >= min_words][:1]
            for end in ends + [i + 1] * (len(plain[i]) >= long_words):
                key = (end - i, " ".join(x for p in plain[i:end] for x in p))
                if key in seen:
                    gone |= set(range(i, end))
                seen.add(key)
        out.append("".join(p for i, p in enumerate(parts) if i not in gone))
    return out


def shingles(text, size=5):
    w = words((text or "").translate(LOW))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def near_groups(texts):
    """The component number of each text: links are 80 % of common shingles of five words."""
    sets = [shingles(t) for t in texts]
    return components(sets, lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b))


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def pseudonymised(texts, key):
    """Texts of e-mail and IP addresses, numbers of three, two and four digits, tokens and names behind titles, split at "; "."""
    from tallywick.llm.pii import TITLES, own_gender, surrogate

    def parts_of(text):
        """Lists of (type, canonical form, as written) and plain strings."""
        pieces = [p for x in text.split("; ") for p in (x, "; ")][:-1]
        roles = {}
        for p in pieces:
            head, _, rest = p.partition(". ")
            if head in TITLES and rest:
                *given, family = rest.split()
                for g in given:
                    roles.setdefault(g, "name_given")
                roles.setdefault(family, "name_family")
        for p in pieces:
            head, _, rest = p.partition(". ")
            if head in TITLES and rest:
                *given, family = rest.split()
                yield f"{head}. "
                for i, g in enumerate(given):
                    yield [("name_given", g.lower(), g, TITLES[head])]
                    yield " "
                yield [("name_family", family.lower(), family, "")]
            elif "@" in p:
                yield [("email_local", p.split("@")[0], p.split("@")[0], "")]
                yield "@"
                yield [("email_domain", p.split("@")[1], p.split("@")[1], "")]
            elif re.fullmatch(r"\d\.\d\.1\.1", p):
                yield [("ip", p, p, "")]
            elif re.fullmatch(r"\d{3}-12-3456", p):
                yield [("ssn", p.replace("-", ""), p, "")]
            elif p.startswith("token="):
                yield "token="
                yield [("secret", p[6:], p[6:], "")]
            else:
                for i, x in enumerate(p.split(" ")):
                    yield " " if i else ""
                    yield [(roles[x], x.lower(), x, "")] if x in roles else x

    split = [list(parts_of(t)) for t in texts]
    genders = defaultdict(set)
    for parts in split:
        for p in parts:
            if isinstance(p, list):
                genders[p[0][:2]] |= {p[0][3]} - {""}
    attempt = dict.fromkeys(genders, 0)
    gender = {e: "" if len(g) > 1 else next(iter(g), own_gender(*e)) for e, g in genders.items()}
    while True:
        made = {e: surrogate(key, *e, n, gender[e]) for e, n in attempt.items()}
        owner = {}
        for kind, canon in sorted(made):
            owner.setdefault((kind, made[kind, canon]), canon)
        lost = [e for e, x in made.items() if owner[e[0], x] != e[1] or (e[0], x) in made]
        if not lost:
            break
        for e in lost:
            attempt[e] += 1

    def shown(kind, canon, written, _):
        x = made[kind, canon]
        if kind.startswith("name"):
            return x.capitalize()
        return f"{x[:3]}-{x[3:5]}-{x[5:]}" if kind == "ssn" else x

    return ["".join(shown(*p[0]) if isinstance(p, list) else p for p in parts) for parts in split]
