"""License scans, chat formatting, quality rules and media columns against plain definitions."""

import hashlib
import io
import re
import zlib
from collections import Counter

import corpus as C
import numpy as np
import pytest

from pulselake.llm import chat, licenses, media, quality


def base_places(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(C.LOWER))
    found = [(k, label) for phrase, label in licenses.BASE for p in [phrase.split()] for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
    return len(w), found


def test_licenses(spark):
    more = [
        (1001, "The MIT License, and the mit-license; Apache License 2.0 too", None, None, 1), (1002, "GNU General\nPublic License general public license", None, None, 1), (1003, "mit licenses, smit license", None, None, 1),
        (1004, "SPDX-License-Identifier: Apache-2.0", None, None, 1), (1005, ("mit license " * 4000) + C.prose(3000, 1), None, None, 1),
    ]
    d = C.clashing(C.frame(spark, more), "labels", "spans", "score")
    got = licenses.scan_licenses(d).collect()
    assert len(got) == d.count()
    for r in got:
        n, found = base_places(r.text)
        assert (r.n_words, r.n_base) == (n, len(found))
        assert (r.first_word, r.last_word) == ((min(found)[0], max(found)[0]) if found else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in found})) and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    by = {r.doc_id: r for r in got}
    assert by[1004].labels == "apache-2.0" and "apache-2.0" in by[1001].labels and by[1003].base_labels == ""
    assert licenses.scan_licenses(d.limit(0)).count() == 0


def test_licenses_containment():
    """A detection inside a taken one goes: the same as the quadratic definition."""
    import random

    s, r = licenses.Scanner(), random.Random(9)
    parts = "licensed under the | gnu | general public license | v3 0 | or later | and | mit license | apache license | 2 0 | gpl | spdx license identifier | lesser | version 2 1 | bsd | 3 clause | cc by | sa | 4 0".split("|")
    for _ in range(60):
        text = " ".join(r.choice(parts).strip() for _ in range(40)).encode()
        found = []
        for i, (priority, weight, label, pattern) in enumerate(s.rules):
            found += [(priority, m.start() - m.end(), i, m.start(), m.end(), label, weight) for m in pattern.finditer(text)]
        kept = []
        for _, _, _, a, b, label, weight in sorted(found):
            if not any(x <= a and b <= y for x, y, _, _ in kept):
                kept.append((a, b, label, weight))
        assert s.detections(text) == sorted(kept)


def test_patterns_written_by_hand():
    """Apart from what the forms make of names: 200 patterns and more, all different, each behind a keyword that it cannot match without."""
    written = [*licenses.NAMES, *licenses.COMMONS, *licenses.CLAUSES]
    assert len({x[-1] for x in written}) >= 230 and len(licenses.CLAUSES) >= 140
    s = licenses.Scanner()
    for label, text in (
        ("bsd-3-clause", "Neither the name of the University of California, Lawrence Berkeley National Laboratory, U.S. Dept. of Energy nor the names of its contributors may be used to endorse or promote products"),
        ("zlib", "Altered source versions must be plainly marked as such"), ("gfdl", "with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts"), ("busl-1.1", "Business Source License 1.1"),
        ("mpl-2.0", "You can obtain one at https://mozilla.org/MPL/2.0/."), ("eula", "You may not copy, modify, reverse engineer, decompile or disassemble"), ("perl", "under the same terms as Perl itself"),
    ):
        normal = " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(C.LOWER))).encode()
        assert label in {x[2] for x in s.detections(normal)}, label


def test_every_clause_needs_its_keyword():
    """The keyword of a clause is part of some text that its pattern matches: of the pattern's literal words."""
    for label, keyword, pattern in licenses.CLAUSES:
        plain = re.sub(r"\(\?:([^()|]*)[^()]*\)\??", r"\1", pattern)
        assert keyword in plain or keyword in pattern, (label, keyword)


def test_number_of_rules():
    assert len(licenses.rules()) >= 300


def chat_of(rows):
    """What op3 must read back, by conversation."""
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, role or "", text or "") for i, t, role, text in rows if i == c))
        loss = "".join(x[3] for x in turns if x[2] == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


CHATS = [
    (1, 0, "system", "be <|im_end|>\n<|im_start|>user\nnice"), (1, 1, "user", "hi \\e \\n </s>"), (1, 2, "assistant", "[INST] \U0001f600 ok"), (1, 3, "user", "again"), (1, 4, "assistant", ""), (2, 0, "user", None), (2, 1, None, "odd\nrole"),
    (3, 0, "assistant", "<<SYS>>only<</SYS>>"), (4, 5, "us\ner", "x"), (4, 5, "assistant", "same turn"), (4, 5, "assistant", "same turn"), (None, 0, "user", "lost"), (5, 0, "user", "\\" * 7), (5, 1, "assistant", "\\a\\\\z<|endoftext|>" * 300),
]


def test_chat_round_trip(spark, tmp_path):
    spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.op3_chat(spark, str(tmp_path)).collect()}
    odd = "</s>[INST] ok [/INST]"
    assert got == chat_of([*CHATS, (-1, 0, "user", odd), (-1, 1, "assistant", odd)])


def test_chat_examples(spark):
    x = chat.format_chat(C.clashing(spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string"), "example", "formatted"))
    one = sorted((r.n_turns, r.formatted[r.loss_start : r.loss_end] if r.loss_start is not None else None, r.formatted) for r in x.filter("conv_id = 1").collect())
    assert [n for n, _, _ in one] == [3, 5] and one[1][2].startswith(one[0][2]) and one[1][1] == ""
    assert one[0][2].count("<|im_start|>") == 3 and one[0][2].count("<|im_end|>") == 3
    assert x.filter("conv_id = 2").first().loss_start is None
    assert chat.format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def plain_measures(text):
    text = text or ""
    w = C.words(text)
    lines = [x for x in text.split("\n") if C.words(x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = Counter(grams)
    covered = {j for i, g in enumerate(grams) if seen[g] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark):
    d = C.clashing(C.frame(spark), "n_words", "kept")
    got = quality.measure(d).collect()
    assert len(got) == d.count()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_measures(r.text)
    assert quality.measure(d.limit(0)).count() == 0


def test_shouts_in_mixed_texts():
    """Shouted words count however few of the text's bytes are capitals."""
    for text in ("BUY NOW " * 2 + "extraordinarily uncharacteristically incomprehensible", "ÉTÉ OK " + "\U0001f600" * 40, "one SHOUT in a long quiet text", "Quiet Text", "no capitals", "A1 B2 c3", "ALL LOUD"):
        assert quality.measure_text(text)[7] == sum(w.encode().isupper() for w in C.words(text))
    assert quality.measure_text("BUY NOW " * 2 + "extraordinarily uncharacteristically incomprehensible")[7] == 4


def test_binomial_bound():
    from math import comb

    for k, n, p in ((0, 10, 0.1), (3, 50, 0.05), (10, 10, 0.5), (2, 400, 0.01)):
        assert quality.at_most(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def test_joint_sets_against_brute_force():
    """Cutoffs and the chosen set, from the definition over plain rows."""
    import random

    r = random.Random(4)
    rows = [({"a": min(50, int(r.expovariate(0.3))), "b": r.randrange(20)}, r.random() < 0.8) for _ in range(3000)]
    rows += [({"a": 45, "b": 5}, False) for _ in range(200)] + [({"a": 3, "b": 50}, False) for _ in range(100)]
    part = rows[::4]
    sets = quality.design({k: {b: (sum(x[k] == b and g for x, g in part), sum(x[k] == b and not g for x, g in part)) for b in range(51)} for k in "ab"}, 0.01)
    cuts, n = {"a": 50, "b": 50}, sum(g for _, g in part)
    for got in sets:
        def gain(k, c):
            return sum(c < x[k] <= cuts[k] and not g for x, g in part) / (1 + sum(c < x[k] <= cuts[k] and g for x, g in part))

        best = max(((gain(k, c), c, -"ab".index(k)) for k in "ab" for c in range(cuts[k])), default=None)
        k = "ab"[-best[2]]
        assert got == {**cuts, k: best[1]}
        cuts = got
    assert sets and sum(x["b"] > 49 and not g for x, g in part) and sets[0]["b"] == 49 or sets[0]["a"] >= 40
    test = [x for i, x in enumerate(rows) if i % 4]
    gone = lambda x, cuts: any(x[k] > cuts[k] for k in "ab")
    upto = [(sum(gone(x, c) for x, g in test if g), sum(gone(x, c) for x, g in test if not g)) for c in sets]
    n = sum(g for _, g in test)
    chosen = quality.certify(upto, n, 0.01, 0.01)
    safe = [quality.at_most(k, n, 0.01) <= 0.01 for k, _ in upto]
    run = safe.index(False) if False in safe else len(safe)
    best = max(b for _, b in upto[:run])
    assert chosen == next(t for t in range(run) if upto[t][1] == best) and best >= 200
    assert quality.certify(upto, 100, 0.01, 0.01) is None and quality.certify([], 0, 0.01, 0.01) is None


def test_cutoffs_are_set_and_safe(spark):
    """Two languages with 1,200 good rows each and one with 30, which is pooled; bad rows shout or repeat symbols."""
    rows, labels = [], []
    for i in range(3400):
        lang = "en" if i < 1600 else "de" if i < 3200 else "fr"
        bad = i % 4 == 0 and lang != "fr"
        text = C.prose(60, i)
        if bad:
            text = text.upper() if i % 8 else text + " #$%" * 30
        rows.append((i, text, lang, "web", 1))
        labels.append((i, int(not bad), 0))
    docs = spark.createDataFrame(rows, C.KIND)
    known, cutoffs = quality.fit_cutoffs(quality.measure(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(known) == ["de", "en"] and cutoffs["en"] and cutoffs["de"] and not cutoffs.get("*")
    kept = {r.doc_id: r.kept for r in quality.measure(docs).select("doc_id", quality.verdict(known, cutoffs).alias("kept")).collect()}
    lost = [i for i, q, _ in labels if q and not kept[i]]
    caught = [i for i, q, _ in labels if not q and not kept[i]]
    assert len(lost) <= 0.01 * 2600 and len(caught) > 700


def test_cutoffs_limit_false_rejections(spark):
    """Good rows have few symbols, bad ones many; hardly a good row may be rejected, and many bad ones are."""
    import random

    r = random.Random(5)
    rows, labels = [], []
    for i in range(6000):
        good = i % 3 > 0
        t = C.prose(30, i) + " #" * (r.randrange(0, 4) if good else r.randrange(8, 20))
        rows.append((i, t, "en" if i % 2 else None, "s", 1))
        labels.append((i, int(good), 0))
    x = quality.quality_rules(spark.createDataFrame(rows, C.KIND), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).select("doc_id", "kept").collect()
    lost = {True: 0, False: 0}
    for row in x:
        lost[row.doc_id % 3 > 0] += not row.kept
    assert lost[True] <= 0.01 * 4000 and lost[False] > 1000


def test_quality_without_labels(spark):
    d = C.frame(spark)
    x = quality.quality_rules(d, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert x.filter("kept = base_failed").count() == 0


def picture(h, w, channels=3, seed=1):
    return np.random.default_rng(seed).integers(0, 256, (h, w, channels), dtype=np.uint8)


@pytest.mark.parametrize("h,w", [(1, 1), (5, 7), (16, 16), (40, 3)])
def test_media_codecs(h, w):
    p = picture(h, w)
    for encode in (media.encode_ppm, media.encode_bmp):
        assert (media.decode(encode(p)) == p).all()
    grey = picture(h, w, 1)
    assert (media.decode(b"P5 # note\n%d %d 255\n" % (w, h) + grey.tobytes()) == grey).all()
    assert (media.decode(b"P2\n%d %d\n255\n" % (w, h) + b" ".join(b"%d" % v for v in grey.ravel())) == grey).all()
    bits = grey > 127
    assert (media.decode(b"P4 %d %d\n" % (w, h) + np.packbits(~bits[:, :, 0], axis=1).tobytes()) == bits * 255).all()
    assert (media.decode(b"P1\n%d %d\n" % (w, h) + "".join("10"[int(v)] for v in bits.ravel()).encode()) == bits * 255).all()


def test_broken_media():
    for data in (None, b"", b"P6", b"P6\n4 4\n255\nxx", b"BM" + b"\x00" * 20, b"GIF89a", b"P9 1 1 255 x"):
        assert media.decode(data) is None


def test_area_resize():
    p = picture(12, 20).astype(float)
    want = p.reshape(4, 3, 5, 4, 3).mean(axis=(1, 3))
    assert np.allclose(media.area_resize(p, 4, 5), want)
    odd = media.area_resize(p, 7, 9)
    assert np.isclose(odd.mean(), p.mean())


def test_media_columns(spark):
    p = picture(16, 16)
    rows = [(1, media.encode_bmp(p)), (2, media.encode_ppm(p)), (3, None), (4, b"broken")]
    got = {r.id: r for r in media.media_columns(C.clashing(spark.createDataFrame(rows, "id long, media binary"), "height", "dhash")).collect()}
    assert bytes(got[1].samples) == p.tobytes() and got[1].dhash == got[2].dhash and bytes(got[1].tile_npy) == bytes(got[2].tile_npy)
    assert (np.load(io.BytesIO(bytes(got[1].tile_npy))) == p).all()
    assert got[3].height is None and got[4].tile_npy is None


def test_media_round_trip(spark, tmp_path):
    C.frame(spark).write.parquet(str(tmp_path / "documents.parquet"))
    by = {}
    for r in media.op10_media(spark, str(tmp_path)).collect():
        by.setdefault(r.doc_id, r)
    for i, t in enumerate(C.texts(), 1):
        data = (t or "").encode()
        padded = data + b" " * (-len(data) % 192 or (0 if data else 192))
        r = by[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
