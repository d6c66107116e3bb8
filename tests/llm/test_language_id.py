import unicodedata
import zlib
from collections import Counter

from conftest_data import ODD

from tidewatch.llm import language_id as lid
from tidewatch.llm.base import documents


def grams_by_hand(text):
    out = Counter()
    padded = []
    for c in (text or "").lower():
        c = c if c.isalpha() else " "
        if c != " " or not padded or padded[-1] != " ":
            padded.append(c)
    line = " " + "".join(padded).strip(" ") + " "
    for n in (1, 2, 3):
        for i in range(len(line) - n + 1):
            g = line[i : i + n]
            if g.strip(" ") and " " not in g[1:-1] and g != " ":
                out[g] += 1
    return out


def number(gram):
    out = 0
    for c in gram:
        out = out << 21 | (lid.BLANK if c == " " else ord(c))
    return out


def top_by_hand(counts, length=lid.PROFILE):
    by = {number(g): n for g, n in counts.items()}
    return sorted(by, key=lambda g: (-by[g], g))[:length]


def predict_by_hand(text, profiles):
    own = top_by_hand(grams_by_hand(text))
    if not own or not profiles:
        return "und", 0.0
    far = {}
    for name, profile in sorted(profiles.items()):
        rank = {g: k for k, g in enumerate(profile)}
        far[name] = sum(abs(rank[g] - k) if g in rank else lid.PROFILE for k, g in enumerate(own))
    best = min(far, key=lambda n: (far[n], n))
    return best, 1 - far[best] / (lid.PROFILE * len(own))


def learned_by_hand(rows):
    counts = {}
    for lang, text in rows:
        if lang is not None:
            counts.setdefault(lang, Counter()).update(grams_by_hand(text))
    return {lang: top_by_hand(c) for lang, c in counts.items() if c}


def test_against_brute_force(spark, sf_dir, odd):
    docs = documents(spark, sf_dir)
    train = lid.training_part(docs)
    rows = train.select("doc_id", "lang", "text").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 != 2 for r in rows)
    profiles = lid.learn_profiles(train)
    assert profiles == learned_by_hand([(r.lang, r.text) for r in rows])
    for table in (docs, odd):
        want = sorted(
            [(r.doc_id, *predict_by_hand(r.text, profiles)) for r in table.collect()], key=repr
        )
        got = sorted([tuple(r) for r in lid.predict(table, profiles).collect()], key=repr)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert all(abs(g[2] - w[2]) < 1e-9 and 0 <= g[2] <= 1 for g, w in zip(got, want))


def test_held_out_accuracy(spark, sf_dir):
    docs = documents(spark, sf_dir)
    profiles = lid.learn_profiles(lid.training_part(docs))
    found = {r.doc_id: r.lang_pred for r in lid.predict(docs, profiles).collect()}
    held = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    long = [r for r in held if len(r.text) > 60]
    assert sum(found[r.doc_id] == r.lang for r in long) >= 0.97 * len(long)


def test_chunks_do_not_change_counts(spark, sf_dir, monkeypatch):
    rows = documents(spark, sf_dir).limit(30)
    whole = lid.learn_profiles(rows)
    monkeypatch.setattr(lid, "CHARS_AT_ONCE", 500)
    monkeypatch.setattr(lid, "HELD_GRAMS", 300)
    assert lid.learn_profiles(rows) == whole


def test_stage(spark, odd, sf_dir, empty):
    profiles = lid.learn_profiles(documents(spark, sf_dir))
    kept = lid.accepted(odd, profiles)
    assert kept.schema == odd.schema
    letters = [r for r in ODD if any(unicodedata.category(c)[0] == "L" for c in r[1] or "")]
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=repr) == sorted(letters, key=repr)
    assert lid.accepted(odd, {}).count() == len(letters)
    assert lid.learn_profiles(empty) == {} and lid.predict(empty, {}).count() == 0
    assert {r.lang_pred for r in lid.predict(odd, {}).collect()} == {"und"}
