"""Plain versions of the operators, for small inputs."""

import re


def word_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def shingles(text):
    w = word_list(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard_groups(texts):
    """doc_id -> least doc_id that links reach."""
    sets = {k: shingles(t) for k, t in sorted(texts.items())}
    top = {k: k for k in sets}

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    keys = [k for k in sets if sets[k]]
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            same = len(sets[a] & sets[b])
            if 100 * same >= 75 * (len(sets[a]) + len(sets[b]) - same):
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
    return {k: root(k) for k in sets}


def removed(texts, length=100):
    """doc_id -> the places of its bytes that a string starting earlier covers."""
    seen, out = set(), {}
    for k in sorted(texts):
        raw, gone = (texts[k] or "").encode(), set()
        for i in range(len(raw) - length + 1):
            if (s := raw[i : i + length]) in seen:
                gone.update(range(i, i + length))
            else:
                seen.add(s)
        out[k] = gone
    return out


def kept_bytes(texts, length=100):
    gone = removed(texts, length)
    return {k: bytes(b for i, b in enumerate((t or "").encode()) if i not in gone[k]) for k, t in texts.items()}
