"""Personal data: spans against the plain patterns, revealing words against brute force over the corpus."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lemmaflow.llm import privacy

#: The contract's patterns, as they stand there.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def luhn(digits):
    return sum((d * 2 - 9 * (d > 4)) if i % 2 else d for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if fits:
                out.append((kind, m.start(), m.end(), {"email": lower(m[0]), "ip": m[0]}.get(kind, digits)))
    return out


def around(text, kind, start, end, window=8):
    """The context of a span between the kind's neighbouring matches, failed ones included."""
    ends = [0] + [m.end() for m in re.finditer(PLAIN[kind], text) if m.end() <= start]
    begins = [m.start() for m in re.finditer(PLAIN[kind], text) if m.start() >= end] + [len(text)]
    left, right = text[ends[-1] : start], text[end : begins[0]]
    if len(left) > 15 * window:
        left = re.sub(f"^(?i:{WORD})", "", left[-15 * window :])
    if len(right) > 15 * window:
        right = re.sub(f"(?i:{WORD})$", "", right[: 15 * window])
    masked = [re.findall(WORD, lower(re.sub("|".join(PLAIN.values()), " ", x))) for x in (left, right)]
    return masked[0][-window:] + masked[1][:window]


def revealing(texts, share=0.95, contexts=3, bits=20.0, letters=3):
    every = Counter(w for t in texts for w in re.findall(WORD, lower(t)))
    prefixes, total = Counter(), sum(every.values())
    for w, n in every.items():
        prefixes[w[:letters]] += n
    near, seen, classes, covers = Counter(), defaultdict(set), Counter(), Counter()
    for t in texts:
        for kind, start, end, value in base(t):
            words, e = around(t, kind, start, end), (kind, value)
            for w in words:
                near[e, w] += 1
                seen[e, w].add(tuple(words))
                classes[e, w[:letters]] += 1
                covers[e] += 1

    def revealed(n, m, c):
        whole = math.log2(total / c)
        return (math.log2(min(1.0, n / m)) + whole) / whole if whole > 0 else 0.0

    out = {}
    for (e, w), n in near.items():
        r = revealed(n, every[w], covers[e])
        if len(seen[e, w]) >= contexts and r >= share and n * r * math.log2(total / covers[e]) >= bits:
            removed = len(w) <= letters or revealed(classes[e, w[:letters]], prefixes[w[:letters]], covers[e]) >= share
            out[w] = out.get(w, False) or removed
    return out


def want(text, words, letters=3):
    own = base(text)
    spans = [":".join(map(str, x[:3])) for x in own]
    for removed in (False, True):
        for m in re.finditer(WORD, lower(text)):
            if words.get(m[0]) is removed and not any(s < m.end() and m.start() < e for _, s, e, _ in own):
                spans.append(f"{'removed' if removed else 'generalised'}:{m.start()}:{m.end()}")
    count = Counter(x[0] for x in own)
    digest = ",".join(":".join(map(str, x[:3])) for x in own)
    return (*[count[k] for k in PLAIN], hashlib.sha256(digest.encode()).hexdigest(), ",".join(spans))


def corpus():
    rng = np.random.default_rng(4)
    vocabulary = [f"w{chr(97 + a)}{chr(97 + b)}{c}" for a in range(12) for b in range(12) for c in range(3)]
    plain = lambda n: " ".join(rng.choice(vocabulary, n))
    texts = [f"{plain(30)} Zorbano {plain(2)} Jo.Smith+1@Mail.example.COM {plain(2)} quilty {plain(30)}" for _ in range(9)]
    texts += [f"{plain(20)} quilty alone {plain(9)}", f"zorbano, {plain(40)}", f"Zorba {plain(40)} quiltmaker quiltings quilt quilts quilted"] + [plain(120) for _ in range(150)]
    texts += [f"quiltmaker quilting quilters quilted {plain(50)}" for _ in range(60)]
    texts += [f"same context vexing 10.1.2.{k // 50} here {plain(0)}" for k in range(40)]
    return texts


ODD = [
    None, "", " ", "@", "a@b", "a@b.c", "x@y.z@u.v", "a.b%c_d@e-f.g.h.", "é@b.co", "a@b.c_d@e.f", "..@-.-", "a@b..c a@b.c.d", "1.2.3", "1.2.3.4", "1.2.3.4.5.6.7.8", "0001.2.3.256", "00000000255.1.1.1", "999.1.1.1.2.3.4",
    "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111 1111 1111", "card:4111111111111111x", "5" * 60, "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "0" * 13, "0" * 19, "0" * 20, "12",
    "+1 (743) 555-3824", "+1 743 555 3824 and +44 20 7946 0958.", "++49 30 123456", "+1", "+12", "+1()2", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7", "+123456789", "+1234567 8901)", "١٢.1.1.1", "😀 a@b.co 😀 +123456789 😀",
    "ip 10.0.0.1 phone +1.10.0.0.1.99 mail q@10.0.0.1", "a@b.co\x00c@d.ef", "mail\ta@b.co\n+1 (743)\n555-3824", "x" * 3000 + "@" + "y" * 3000 + ".z", "1 " * 3000, "a@b." * 3000, "1.2." * 3000, "+1 " + " " * 3000, "é" * 3000,
]


def test_report_matches_brute_force(spark):
    texts = corpus() + ODD
    rows = [(k, t, "x", 1) for k, t in enumerate(texts)] + [(None, "a@b.co", None, None), (5, texts[5], "y", 2), (5, texts[5], "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string, word int")
    words = revealing([t or "" for _, t, *_ in rows])
    assert words.get("zorbano") is True and words.get("quilty") is False
    got = sorted(((r.doc_id is None, r.doc_id or 0), (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans)) for r in privacy.privacy_report(docs).collect())
    assert got == sorted(((i is None, i or 0), want(t or "", words)) for i, t, *_ in rows)


def test_texts_are_sanitised(spark):
    rows = [(k, t, "x") for k, t in enumerate(corpus())] + [(900, None, None), (901, "a@b.co, 10.0.0.1 or +1.10.0.0.1.999!", "x"), (901, "a@b.co, 10.0.0.1 or +1.10.0.0.1.999!", "x"), (None, "q", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, email string")
    out = privacy.sanitised(docs)
    assert out.columns == docs.columns
    got = [(r.doc_id, r.text, r.email) for r in out.collect()]
    assert len(got) == len(rows) and (900, None, None) in got and (None, "q", "x") in got
    assert got.count((901, "[email], [ip] or [phone]!", "x")) == 2
    first = next(t for i, t, _ in got if i == 0)
    assert "[email]" in first and "[word]" in first and "qui*" in first and not re.search("smith|zorbano|quilty", lower(first))
    alone = next(t for i, t, _ in got if i == 9)
    assert "qui* alone" in alone


@pytest.mark.parametrize("n", [0, 1])
def test_small_tables(spark, n):
    docs = spark.createDataFrame([(1, None)][:n], "doc_id long, text string")
    assert [tuple(r) for r in privacy.privacy_report(docs).collect()] == [(1, 0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "")][:n]
    assert privacy.sanitised(docs).count() == n
