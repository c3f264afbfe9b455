"""License scan: phrases by regular expressions, template matches by trying every block and template."""

import random
import re
import textwrap

from maskbench.llm import licenses as lc


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda x: x[0].lower(), t or ""))


def plain(t, threshold=lc.THRESHOLD):
    w, places, base = words(t), [], set()
    for phrase, label in lc.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i:i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    lines, best = (t or "").split("\n"), {}
    for i in range(len(lines)):
        for j in range(i + 1, min(i + 4, len(lines)) + 1):
            block = set(words("\n".join(lines[i:j])))
            for label, template in lc.TEMPLATES:
                s = set(words(template))
                c = len(s & block) / len(s)
                if c >= threshold:
                    best[label] = max(best.get(label, 0), c)
    score = 1.0 if base else max([0.0, *best.values()])
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | set(best))), score


def test_against_every_block(spark):
    rng = random.Random(2)
    bank = [w for _, t in lc.TEMPLATES for w in t.split()] + ["the", "prose", "É", "of", "x9", "MIT license", "apache-LICENSE"]
    rows = []
    for i in range(300):
        lines = []
        for _ in range(rng.randint(0, 5)):
            t = rng.choice(lc.TEMPLATES)[1].split()
            if rng.random() < 0.5:
                t[rng.randrange(len(t))] = rng.choice(bank)
            if rng.random() < 0.5:
                t.insert(rng.randrange(len(t)), "\n")
            lines.append(" ".join(t) if rng.random() < 0.7 else " ".join(rng.choice(bank) for _ in range(rng.randint(0, 12))))
        rows.append((i, "\n".join(lines)))
    rows += [(900, None), (901, ""), (902, "mit license mit license"), (902, "mit license mit license"), (None, "General.Public\nLicense " * 4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "1 as labels", "2 as score", "3 as `a.b`")
    got = sorted((r[0] is None, r[0] or 0, tuple(r[1:8])) for r in lc.scan(docs).collect())
    want = sorted((d is None, d or 0, plain(t)) for d, t in rows)
    assert got == want
    assert lc.scan(docs.where("false")).count() == 0


def test_spans(spark):
    docs = spark.createDataFrame([(1, "some prose\nReleased under\nthe MIT License.\nmore")], "doc_id long, text string")
    r = lc.scan(docs).first()
    assert [(x["label"], x["first_word"], x["last_word"], x["containment"]) for x in r["matches"]][0][0] == "mit-notice"
    assert r["matches"][0]["containment"] == 1.0 and r["first_word"] == 5


def blocks(t, size):
    """All blocks of lines for a template of so many words, tried one by one."""
    lines = [words(x) for x in t.split("\n")]
    for i in range(len(lines)):
        for j in range(i + 1, len(lines) + 1):
            block = [w for x in lines[i:j] for w in x]
            if j - i <= 4 or len(block) <= 2 * size:
                yield block


def test_wrapped_texts_against_every_block(spark):
    rng, rows = random.Random(4), []
    for i in range(24):
        t = rng.choice(lc.TEXTS + lc.TEMPLATES)[1].split()
        for _ in range(rng.randint(0, len(t) // 8)):
            t[rng.randrange(len(t))] = "other"
        width = rng.choice([1, 2, 5, 12, 40])
        lines = [rng.choice(["", "# ", " * "]) + " ".join(t[k:k + width]) for k in range(0, len(t), width)]
        if rng.random() < 0.3:
            lines[1:1] = ["far away"] * rng.choice([1, 40])
        rows.append((i, "\n".join(["some prose"] * rng.randint(0, 3) + lines + ["the end of it"] * rng.randint(0, 3))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: {(m.label, m.containment) for m in r.matches} for r in lc.scan(docs).collect()}
    for d, t in rows:
        want = set()
        for label, template in lc.TEMPLATES + lc.TEXTS:
            s = set(words(template))
            c = max(len(s & set(b)) / len(s) for b in blocks(t, len(words(template))))
            want |= {(label, c)} if c >= lc.THRESHOLD else set()
        assert got[d] == want, (d, got[d], want)


def test_whole_license_has_its_label(spark):
    """Each text wrapped at one word a line and at 60 characters gets its own label; so does a reserved right."""
    rows = [(2 * k + n, "A title\n\n" + "\n".join(textwrap.wrap(t, w, break_long_words=False))) for k, (_, t) in enumerate(lc.TEXTS) for n, w in enumerate((1, 60))]
    docs = spark.createDataFrame(rows + [(99, "(c) 2020 Someone.\nAll rights reserved.\n")], "doc_id long, text string")
    got = {r.doc_id: r for r in lc.scan(docs).collect()}
    assert all(label in got[2 * k + n].labels.split(",") for k, (label, _) in enumerate(lc.TEXTS) for n in (0, 1))
    assert got[99].labels == "rights-reserved" and [(m.block, m.first_word, m.last_word) for m in got[99].matches] == [(1, 3, 5)]
