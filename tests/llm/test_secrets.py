"""The secret scan against brute force: base patterns, best paths, odd rows."""

import hashlib
import random
import re
import time

import numpy as np

from waymark.llm import secrets


def test_secrets_of_every_shape():
    rng = random.Random(5)
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    upper, lower = "ABCDEFGHJKLMNPQRSTUVWXYZ", "bcdfghjklmnpqrstvwxz"
    say = lambda n: " ".join(rng.choice("the of and a well-known river runs from here to old stone houses in may".split()) for _ in range(n))
    kinds = {"groups": lambda: "-".join(pick(upper, 2) + pick("0123456789", 2) for _ in range(4)), "letters": lambda: pick(upper + lower, 20), "phrase": lambda: "-".join(pick(lower, 5) for _ in range(4)), "short": lambda: pick(lower, 4) + pick("0123456789", 4)}
    made = {k: [f"{say(20)} token = {f()} {say(9)}" for _ in range(40)] for k, f in kinds.items()}
    plain = [say(30) for _ in range(80)]
    field = secrets.Field.trained(secrets.examples([t for v in made.values() for t in v] + plain))
    for kind, texts in made.items():
        want = [[s for v in secrets.base_spans(t).values() for s in v] for t in texts]
        assert sum(secrets.crf_spans(field, t, []) == w for t, w in zip(texts, want)) >= 36, kind
    assert not any(secrets.crf_spans(field, t, []) for t in plain)
    # what is decoded by stretches is the best path of the whole text, also for several texts at once
    batch = [x[0] for x in made.values()] + ["", plain[0] + "\n" + made["groups"][1], "x", "\u3000é-1=AB12-CD34-EF56-GH78"]
    for t, found in zip(batch, field.decoded(batch)):
        spans = [x.span() for x in secrets.TOKEN.finditer(t)]
        if not spans:
            assert not found
            continue
        s = field.scores(secrets.feature_ids(secrets.token_features(t, spans, secrets.file_features(t))), secrets.allowed(t, spans))
        assert np.allclose(s, field.text_scores(secrets.Tokens([t]), [t]))
        path, want = field.viterbi(s), []
        for k, y in enumerate(path):
            if y == secrets.BEGIN:
                want.append([spans[k][0], spans[k][1]])
            elif y == secrets.INSIDE:
                want[-1][1] = spans[k][1]
        assert [list(x) for x in found] == want


def test_base_spans_by_brute_force():
    """Each kind scanned character by character, leftmost first."""
    rng = random.Random(8)
    key = re.compile("password|passwd|secret|token|api_?key", re.I | re.A)

    def plain(text):
        out = {"assign": [], "access": [], "hex": []}
        value = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
        at = 0
        while at < len(text):
            m = key.match(text, at)
            end = -1
            if m and m[0].isascii():
                k = m.end()
                k += text[k : k + 1] in ("'", '"') and k < len(text)
                while text[k : k + 1] == " ":
                    k += 1
                if text[k : k + 1] in (":", "=") and k < len(text):
                    k += 1
                    while text[k : k + 1] == " ":
                        k += 1
                    k += text[k : k + 1] in ("'", '"') and k < len(text)
                    end = k
                    while end < len(text) and text[end] in value:
                        end += 1
                    if end - k >= 6:
                        out["assign"].append((k, end))
                    end = end if end > k else -1
            at = end if end > 0 else at + 1
        for kind, head, chars, least in (("access", "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20), ("hex", "", "0123456789abcdef", 24)):
            at = 0
            while at < len(text):
                if not text.startswith(head, at):
                    at += 1
                    continue
                end = at + len(head)
                while end < len(text) and text[end] in chars:
                    end += 1
                if end - at >= least:
                    out[kind].append((at, end))
                at = max(end, at + 1) if end > at + len(head) else at + 1
        return out

    bits = ["token", "Api_Key", "apikey", "SECRET", "passwd", "ſecret", "paßword", "=", ":", " ", " ", '"', "'", "abc123", "x", "/+.", "AKIA", "AKIAAKIA", "Q7" * 8, "0f" * 11, "a1" * 13, "\n", "é"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        assert secrets.base_spans(text) == plain(text), text


def test_scan_is_linear_in_a_text():
    field = secrets.Field.trained(secrets.examples(["a token = " + "0f" * 20 + " b c d e f g"] * 5 + ["plain words stand here"] * 5))
    text = " ".join(f"{k * 2654435761 % (1 << 128):032x}" for k in range(30_000))
    began = time.time()
    base = [x for v in secrets.base_spans(text).values() for x in v]
    secrets.crf_spans(field, text, base)
    assert len(base) > 25_000 and time.time() - began < 10


def test_scan_of_odd_rows(spark):
    """Null, empty and repeated texts, extra columns with clashing names, and an empty table."""
    text = "token = abcdef99 and AKIA" + "Q" * 16
    rows = [(1, None, "a", 1), (2, "", "b", 2), (3, text, "c", 3), (3, text, "c", 3), (None, text, "d", 4), (4, "pass" * 50_000, "e", 5)]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, spans string, h long")).collect()
    empty = hashlib.sha256(b"").hexdigest()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert {k: len(v) for k, v in by.items()} == {1: 1, 2: 1, 3: 2, None: 1, 4: 1}
    assert all(by[k][0]["base_sha256"] == empty and not by[k][0]["spans"] for k in (1, 2, 4))
    want = "assign:8:16,access:21:41"
    for r in (*by[3], *by[None]):
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (1, 1, 0) and r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert {*want.split(",")} <= {*r["spans"].split(",")}
    assert secrets.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
