import random
import re

from cases import frame

from tapeworks.llm import secret_scan as scan

PATTERNS = [
    re.compile(r"((?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A),
    re.compile(r"AKIA[A-Z0-9]+"),
    re.compile(r"[0-9a-f]+"),
]
LEAST = [lambda m: len(m[2]) >= 12, lambda m: len(m[0]) >= 18, lambda m: len(m[0]) >= 16]


def brute(text):
    spans = [(m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in p.finditer(text or "") if LEAST[k](m)]
    return sorted(spans)


def secret(rng, n=24, letters=scan.ALPHABET):
    return "".join(rng.choice(letters) for _ in range(n))


def texts():
    rng = random.Random(3)
    hexes = "0123456789abcdef"
    out = [None, "", "token=", "AKIA", "token=token=abcdefghijklmnop", "secret=token :abcdefghijklmnop", "x" * 300_000]
    out += ["é𝒳 password = '%s'" % secret(rng, 12), "Api_Key:%s AKIA%s" % (secret(rng), "A1" * 7), "apikey=short"]
    out += ["paſſword=%s Key" % secret(rng), "TOKEN\":\"%s" % secret(rng, 11, hexes), secret(rng, 40, hexes)]
    for _ in range(40):
        parts = [
            rng.choice(["api_key", "Password", "token", "AKIA", "", "é", "passwd\"", "secret'"]),
            rng.choice([" = ", ":", "=\"", " ", "  :  '"]),
            secret(rng, rng.randrange(1, 40), rng.choice([scan.ALPHABET, hexes, "ABC123"])),
        ]
        out.append(" ".join("".join(parts) for _ in range(rng.randrange(1, 4))))
    return out


def test_known_forms_match_brute_force(spark):
    rows = list(enumerate(texts())) + [(None, "token=abcdefghijklmnop"), (1, ""), (1, "")]
    table = [0.0] * len(scan.ALPHABET) ** 2
    got = scan.scan(frame(spark, rows, clash=True), table).collect()
    want = sorted((str(i), str(brute(t))) for i, t in rows)
    assert sorted((str(r.doc_id), str([tuple(x) for x in r.spans])) for r in got) == want
    assert scan.scan(frame(spark, []), table).count() == 0


def ordinary(rng):
    pieces = ["get", "set", "user", "name", "list", "item", "count", "ing", "tion", "value", "_", "er", "in"]
    return "".join(rng.choice(pieces) for _ in range(rng.randrange(5, 9)))


def test_models_tell_random_from_ordinary(spark):
    rng = random.Random(5)
    learn = [(i, " ".join([ordinary(rng) for _ in range(10)] + ["token=" + secret(rng, 30)])) for i in range(200)]
    table = scan.learn(frame(spark, learn))
    held = [(i, "see %s here" % secret(rng, 28)) for i in range(200)]
    held += [(1000 + i, "see %s here" % (ordinary(rng) + "_" + ordinary(rng))) for i in range(200)]
    found = {r.doc_id: len(r.spans) for r in scan.scan(frame(spark, held), table).collect()}
    caught = sum(found[i] for i in range(200)) / 200
    wrong = sum(found[1000 + i] for i in range(200)) / 200
    assert caught > 0.95 and wrong < 0.03


def test_learning_from_nothing_is_even(spark):
    assert set(scan.learn(frame(spark, []))) == {0.0}


def test_written(spark):
    row = frame(spark, [(1, "token=abcdefghijklmnop 0123456789abcdef")])
    spans = scan.scan(row, [0.0] * len(scan.ALPHABET) ** 2)
    assert spans.select(scan.written(spans["spans"])).first()[0] == "assign:0:22,hex:23:39"
