"""Plain versions of the operators: small, slow, and without anything of theirs."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def white_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def base_scores(docs):
    """doc_id to held_out, n_tokens, n_known, N, base score."""
    count = Counter()
    for d, t in docs:
        if fold(d, 10):
            count.update([*white_words(t), "\n"])
    total = sum(count.values())
    out = {}
    for d, t in docs:
        ws = [*white_words(t), "\n"]
        out[d] = fold(d, 10) == 0, len(ws), sum(count[w] > 0 for w in ws), total, sum(math.log10((count[w] + 0.1) / (total + 0.1 * (len(count) + 1))) for w in ws)
    return out


def backoff_scores(docs, prior, growth):
    """doc_id to the log10 probability under the bigram model of all training bigrams, smoothed towards the words' base probabilities."""
    count, pairs = Counter(), Counter()
    for d, t in docs:
        if fold(d, 10):
            ws = ["\n", *white_words(t), "\n"]
            count.update(ws[1:])
            pairs.update(zip(ws, ws[1:], strict=False))
    total = sum(count.values())
    p = lambda w: (count[w] + 0.1) / (total + 0.1 * (len(count) + 1))
    out = {}
    for d, t in docs:
        ws, score = ["\n", *white_words(t), "\n"], 0.0
        for a, b in zip(ws, ws[1:], strict=False):
            m = prior * count[a] ** growth
            score += math.log10((pairs[a, b] + m * p(b)) / (count[a] + m) if count[a] else p(b))
        out[d] = score
    return out


def captures(pages):
    last = {}
    for page, html in pages:
        last[html or ""] = max(page, last.get(html or "", page))
    out = {}
    for page, html in pages:
        body = (html or "").encode()
        first = last[html or ""] == page
        out[page] = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if first else "revisit", None if first else last[html or ""]
    return out


def mark_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def contaminated(docs, items, window=10):
    places = defaultdict(set)
    for item, text in items:
        ws = mark_words(text)
        n = min(window, len(ws))
        for i in range(len(ws) - n + 1 if n else 0):
            places[tuple(ws[i : i + n])].add(str(item))
    sizes = {len(w) for w in places}
    out = {}
    for d, text in docs:
        ws, hit, found = mark_words(text), set(), set()
        for n in sizes:
            for i in range(len(ws) - n + 1):
                own = places.get(tuple(ws[i : i + n]))
                if own:
                    hit.update(range(i, i + n))
                    found |= own
        out[d] = len(ws), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)
    return out


def encoded(docs, path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    out = {}
    for d, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids
        out[d] = len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))
    return out


def without_repeats(docs, n=100):
    seen, out = set(), {}
    for d, text in sorted(docs):
        body = (text or "").encode()
        gone = bytearray(len(body))
        for i in range(len(body) - n + 1):
            w = body[i : i + n]
            if w in seen:
                gone[i : i + n] = b"\1" * n
            seen.add(w)
        runs = len(re.findall(b"\1+", bytes(gone)))
        out[d] = len(body), sum(gone), runs, sha(bytes(b for b, g in zip(body, gone, strict=True) if not g))
    return out


def base_secrets(text):
    found = []
    for m in re.finditer(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, m.end(), "assign"))
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(kind, a, b) for a, _, b, kind in sorted(found)]


def entropy(text):
    return -sum(c / len(text) * math.log2(c / len(text)) for c in Counter(text).values())


def entropy_windows(run, rule, settings):
    """Places in hot windows, each window judged anew; those that the allow list knows are left out."""
    hot, w = set(), rule.window
    if settings.known.fullmatch(run):
        return hot
    for i in range(len(run) - w + 1):
        some = run[i : i + w]
        if any(m.start() < i + w and i < m.end() for m in settings.examples.finditer(run)):
            continue
        if any(min(m.end(), i + w) - max(m.start(), i) >= w // 2 for m in settings.ascending.finditer(run)):
            continue
        changes = sum(a.isupper() and b.islower() or a.islower() and b.isupper() for a, b in zip(some, some[1:], strict=False))
        enough = sum(c.isdigit() for c in some) >= rule.digits and sum(c.isalpha() for c in some) >= rule.letters and changes >= rule.changes
        if set(some) <= rule.alphabet and enough and entropy(some) >= rule.bits - 1e-12:
            hot.update(range(i, i + w))
    return hot


def nearest(vectors, every, k):
    out = []
    for q, x in vectors:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), v) for v, y in vectors if v != q)[:k]
            out += [(q, r, v, -s) for r, (s, v) in enumerate(scored, 1)]
    return out


def near_components(docs, n=4, least=85):
    sets = {}
    for d, text in docs:
        ws = white_words(text)
        sets[d] = {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if len(ws) >= n else ({tuple(ws)} if ws else set())
    label = {d: d for d in sets}

    def top(d):
        while label[d] != d:
            d = label[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small and 100 * small >= least * large:
                both = len(sets[a] & sets[b])
                if 100 * both >= least * (len(sets[a]) + len(sets[b]) - both):
                    x, y = top(a), top(b)
                    label[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), top(d)) for d in ids}


def unigram_tokens(word, scores, byte):
    """Tokens of the best segmentation, fewer tokens first among equals; plain forward pass over all splits."""
    best = [(0.0, 0)]
    for at in range(1, len(word) + 1):
        ways = []
        for start in range(at):
            s = scores.get(word[start:at])
            if s is not None:
                ways.append((best[start][0] + s, best[start][1] + 1))
        if word[at - 1] not in scores:
            n = len(word[at - 1].encode())
            ways.append((best[at - 1][0] + n * byte, best[at - 1][1] + n))
        best.append(max(ways, key=lambda w: (round(w[0], 9), -w[1])))
    return best[-1][1]


def simhashes(docs):
    """doc_id to fingerprint and component, every pair compared."""
    prints = {}
    for d, text in docs:
        ws = white_words(text)
        grams = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else ([" ".join(ws)] if ws else [])
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints[d] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    label = {d: d for d in prints}
    top = lambda d: d if label[d] == d else top(label[d])
    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = top(a), top(b)
                label[max(x, y)] = min(x, y)
    return {d: (f"{prints[d]:016x}", top(d)) for d in ids}


def one_apart(a, b):
    """Whether one code point inserted, deleted or replaced makes one word the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spellings(docs):
    """word to form, root, n, n_near, form_n; every pair of words compared."""
    count = Counter()
    for d, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lower(w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    out = {}
    for w, n in words.items():
        near = [u for u in words if one_apart(w, u)]
        best = min(near, key=lambda u: (-words[u], u), default=None)
        form = best if best is not None and words[best] >= 5 * n else None
        out[w] = form, n, len(near), words.get(form)
    def root(w):
        return w if out[w][0] is None else root(out[w][0])
    return {w: (form, root(w), n, near, m) for w, (form, n, near, m) in out.items()}


def divergences(docs):
    """(lang, source, part, item, value, rank) of rows of lang, source and text, every term of every pair looked at."""
    count, rows, groups = Counter(), Counter(), set()
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = [lower(w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        count.update((lang, source, w) for w in found)
        rows.update({(lang, w) for w in found})
    out = []
    for lang in {g[0] for g in groups}:
        kept = [w for (at, w), n in rows.items() if at == lang and n >= 10]
        own = sorted(s for at, s in groups if at == lang)
        counts = {s: {w: count[lang, s, w] for w in kept} for s in own}
        counts[None] = {w: sum(counts[s][w] for s in own) for w in kept}
        p = {s: {w: 1 + 10**9 * (n + 2) // (sum(c.values()) + 2 * len(kept)) for w, n in c.items()} for s, c in counts.items()}
        f = lambda s, t, w: (p[s][w] - p[t][w]) ** 2 // (p[s][w] + p[t][w])  # noqa: B023, E731
        for s in own:
            pairs = [(-sum(f(s, t, w) for w in kept), t.encode(), t) for t in own if t != s]
            terms = [(-f(s, None, w), w.encode(), w) for w in kept if counts[s][w] and p[s][w] > p[None][w]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:10])):
                out += [(lang, s, part, item, -v, rank) for rank, (v, _, item) in enumerate(items, 1)]
    return sorted(out)
