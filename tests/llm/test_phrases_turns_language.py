"""Operators 11 to 13 against brute force, an exact round of edits, and held-out accuracy; and what was mended in 2, 4 and 9."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import regex

from gridflow.llm import language, phrases, pii, tokenfile, topk, turns

WHITE = " \t\n\x0b\x0c\r"
ROLES = ("user", "assistant", "system", "tool", None, "")


# ---------------------------------------------------------------- 11


def damaged(rows):
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text, fault = (" " if role is None else role), (" " if text is None else text), zlib.crc32(key.encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        for copy in range(2 if fault == 3 else 1):
            yield conv, turn, "user" if fault == 4 else role, text, copy


def cheapest(rows):
    """Results of one conversation, its edits found by a search over all edit strings in the order of cost and letters."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode(), r[4]))
    at = {r[1] for r in rows if r[1] is not None}
    seen, faults = set(), []
    for _, _, role, text, _ in rows:
        bare = text.strip(WHITE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    heap, done = [(0, "", 0, "")], set()
    while True:
        cost, audit, i, made = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", made):
            break
        state = (i, made[-1:])
        if state in done:
            continue
        done.add(state)
        steps = [(2, "I", i, c) for c in "ua"]
        if i < len(rows):
            steps.append((3, "D", i + 1, ""))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                steps += [(more, "K", i + 1, rows[i][2][:1] or "x")] + [(2 + more, "R", i + 1, c) for c in "ua"]
        for price, letter, to, c in steps:
            # what has been made can still become a word of the grammar
            if c == "" or (made[-1:], c) in (("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")):
                heapq.heappush(heap, (cost + price, audit + letter, to, made + c))
    out, i, stay, place = [], 0, len(audit) - audit.count("D"), 0
    for letter in audit:
        place += letter != "D"
        role = "assistant" if (stay - place) % 2 == 0 else "user"
        if letter in "KR":
            out.append(f"{rows[i][2] if letter == 'K' else role}:{rows[i][3]}")
        elif letter == "I":
            out.append(f"{role}:")
        i += letter != "I"
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    gaps = max(at) - min(at) + 1 - len(at) if at else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def all_cheapest(rows):
    by = {}
    for r in damaged(rows):
        by.setdefault(r[0], []).append(r)
    return {c: cheapest(by.get(c, [])) for c in {r[0] for r in rows}}


def talk(rng, n, conv):
    texts = ["", "a.", "b!", "c", None, "  ", "d d.\n", "é?", "ß"]
    return [(conv, rng.choice([None, *range(max(2, n))]), rng.choice(ROLES), rng.choice([*texts, f"x{rng.random()}", f"y{rng.randrange(9)}."])) for _ in range(n)]


TALK = "conv_id long, turn long, role string, text string"


def repaired(df):
    return {r["conv_id"]: tuple(r)[1:] for r in turns.repair(turns.damaged(df), df).collect()}


def test_registered_repair_equals_a_search_over_all_edits(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = turns.op11_conversation_repair(spark, sf)
    assert {r["conv_id"]: tuple(r)[1:] for r in got.collect()} == all_cheapest(rows)


def test_repair_of_odd_rows(spark):
    rng = random.Random(3)
    rows = [r for c in range(50) for r in talk(rng, rng.randrange(1, 12), c)] + talk(rng, 20, None)
    rows += [(900, 1, "user", "ab " * 100_000 + "."), (900, 2, "assistant", "x" * 300_000)] + [(901, 5, "user", "hm.")] * 7
    df = spark.createDataFrame(rows, TALK).selectExpr("*", "turn AS unit", "text AS best")
    assert repaired(df) == all_cheapest(rows)


def test_repair_in_pieces(spark, monkeypatch):
    for name, value in (("LONG", 6), ("PIECE", 4), ("FAN", 3)):
        monkeypatch.setattr(turns, name, value)
    rng = random.Random(5)
    rows = [r for c in range(20) for r in talk(rng, rng.randrange(1, 9), c)] + talk(rng, 30, None) + talk(rng, 300, 777) + talk(rng, 100, 778) + [(779, 3, "user", "again.")] * 60
    assert repaired(spark.createDataFrame(rows, TALK)) == all_cheapest(rows)


def test_repair_of_no_rows(spark):
    df = spark.createDataFrame([], TALK)
    assert turns.repair(turns.damaged(df), df).collect() == []
    gone = next(c for c in range(99) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    (row,) = repaired(spark.createDataFrame([(gone, 1, "user", "hi.")], TALK)).values()
    assert row == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


# ---------------------------------------------------------------- 12


def counted(docs, least, cover):
    """All phrases by plain counting: {(lang, phrase): (a, l, r, n, score)}."""
    f = {}
    for lang, text in docs:
        own = f.setdefault(lang or "und", Counter())
        plain = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", plain):
            words = re.findall("[^ \t]+", piece)
            for k in (1, 2, 3):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = {}
    for lang, own in f.items():
        n = sum(c for p, c in own.items() if len(p) == 1)
        for p, a in own.items():
            if len(p) == 1 or a < least:
                continue
            if len(p) == 2 and any(c >= least and 100 * c >= cover * a for q, c in own.items() if len(q) == 3 and p in (q[:2], q[1:])):
                continue
            score, _, left, right = min((1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            out[lang, " ".join(p)] = (a, left, right, n, score)
    return out


def mined(df, **given):
    rows = phrases.collocations(df, **given).collect()
    assert [r["rank"] for r in sorted(rows, key=lambda r: (r.lang, r["rank"]))] == [k for _, g in itertools.groupby(sorted(r.lang for r in rows)) for k, _ in enumerate(g, 1)]
    order = sorted(rows, key=lambda r: (r.lang, -r.score, -r.a, r.phrase.encode()))
    assert [r["rank"] for r in order] == [r["rank"] for r in sorted(rows, key=lambda r: (r.lang, r["rank"]))]
    return {(r.lang, r.phrase): (r.a, r.l, r.r, r.n, r.score) for r in rows}


def prose(rng, n):
    words = ["a", "B", "of", "The", "é", "x\x00y", "ΑB", "ten"]
    signs = [" ", " ", " ", "  ", "\t", ". ", ",", "!?", "\n", "\x0b"]
    for _ in range(n):
        yield rng.choice(["en", "de", None]), rng.choice([None, "", " . ", "".join(rng.choice(words) + rng.choice(signs) for _ in range(rng.randrange(60)))])


@pytest.mark.parametrize("block", [40, 1 << 20])
def test_phrases_equal_plain_counting(spark, block):
    docs = list(prose(random.Random(block), 150)) + [("en", "one two three. " * 5000 + "one two " * 3)]
    df = spark.createDataFrame(docs, "lang string, text string").selectExpr("*", "lang AS words", "text AS n").repartition(3)
    assert mined(df, least=4, block=block) == counted(docs, 4, 50)


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BLOOM", 64)  # full after a few words
    docs = list(prose(random.Random(1), 80))
    df = spark.createDataFrame(docs, "lang string, text string")
    assert mined(df, least=3) == counted(docs, 3, 50)


def test_registered_phrases(spark, sf):
    docs = [(r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {(r.lang, r.phrase): (r.a, r.l, r.r, r.n, r.score) for r in phrases.op12_phrase_collocations(spark, sf).collect()}
    assert got == counted(docs, 10, 50)  # less than 2,000 a language here


def test_no_phrases_of_no_rows(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).isEmpty()
    assert phrases.collocations(spark.createDataFrame([("en", None), (None, "...")], "lang string, text string")).isEmpty()


# ---------------------------------------------------------------- 13


def test_held_out_languages(spark, sf):
    got = {r.doc_id: r for r in language.op13_language_ftrl(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got.values())
    assert all(got[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2) for d in docs)
    held = [d for d in docs if got[d.doc_id].held_out]
    assert sum(got[d.doc_id].lang_pred == d.lang for d in held) >= 0.95 * len(held)


def test_nothing_is_learned_from_held_out_rows(spark):
    texts = {"xx": "abra kadabra abba ", "yy": "zumm tropf zilpzalp "}
    rows = [(i, lang, t * 3) for i in range(80) for lang, t in texts.items()]
    other = [(i, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, t) for i, lang, t in rows]
    seen = []
    for data in (rows, other):
        df = spark.createDataFrame(data, "id long, lang string, text string")
        m = language.fit(df.where(~language.held_out(df["id"])))
        seen.append((m.names, m.weights.tolist(), m.temperature))
    assert seen[0] == seen[1] and seen[0][0] == ["xx", "yy"]
    assert 0 < np.count_nonzero(seen[0][1]) < np.size(seen[0][1]) / 100  # sparse


def test_counts_of_long_texts_are_those_of_their_words():
    text = "Ab cé! " * 40_000 + "q" * 200_000 + " 12 zz"
    at, n = language.counts(text)
    one = language.counts("ab")
    assert dict(zip(*map(np.ndarray.tolist, language.counts("ab cé")), strict=True)).keys() <= set(at.tolist())
    assert n[np.searchsorted(at, one[0])].min() >= 40_000
    assert [len(x) for x in language.counts("12 !? \n")] == [0, 0] == [len(x) for x in language.counts(None)]


def test_odd_rows_have_a_language(spark):
    rows = [(1, "en", "the cat"), (1, "en", "the cat"), (None, "de", "der hund"), (2, None, "le chat"), (3, "de", None), (4, "en", ""), (5, "en", "123"), (6, "fr", "le chien " * 50_000)]
    df = spark.createDataFrame(rows, "id long, lang string, text string")
    m = language.fit(df)
    got = [(r.text, r.told) for r in df.select("text", language.identify(m, df["text"]).alias("told")).collect()]
    assert all((t["lang"], t["score"]) == ("und", 0.0) for x, t in got if not x or x == "123") and all(t["lang"] in ("en", "de", "fr") for x, t in got if x and x != "123")
    assert language.fit(df.limit(0)) is None and language.fit(df.where("lang IS NULL")) is None
    assert df.select(language.identify(None, df["text"]).alias("t")).first()["t"]["lang"] == "und"


def test_temperature_is_the_best_one():
    rng = np.random.default_rng(1)
    z = rng.normal(size=(2000, 3))
    y = np.array([rng.choice(3, p=p) for p in language.softmax(z)])
    assert abs(language.fit_temperature(z * 2.5, y) - 2.5) < 0.25


# ---------------------------------------------------------------- 2, 4 and 9


def test_smallest_array_of_a_repeated_id(spark):
    rows = spark.createDataFrame([(50, [0.002, 3.0]), (50, [0.001, 5.0]), (50, [float("nan"), 0.0])], "vec_id long, embedding array<double>")
    assert [(r.id, r.w) for r in topk.quantised(rows).collect()] == [(50, [0, 1280])]


@pytest.mark.parametrize(("size", "different"), [(100_000, 100_000), (260_000, 200_000), (300, 300)])
def test_files_of_many_different_ids(size, different):
    rng = np.random.default_rng(size)
    ids = [rng.permutation(size)[:different].astype(np.int32), np.array([], np.int32), rng.integers(0, size, 5000).astype(np.int32)]
    names, got = tokenfile.unpack_file(tokenfile.pack_file([3, None, 3], ids, size))
    assert names == [3, None, 3] and all(np.array_equal(a, b) for a, b in zip(ids, got, strict=True))


def mod97(iban):
    turned = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in turned[4:] + turned[:4])) % 97


PAIRS = {
    # mentions of one entity, and of another
    "phone": (["+1 555 123 4567", "+15551234567", "(555) 123-4567", "555-123-4567"], ["+49 151 23456789", "+4915123456789", "+49 (151) 2345 6789"], ["+358 40 1234567", "+358401234567"]),
    "email": (["İzmir@Example.com", "İzmir@example.com"], ["izmir@example.com"], ["a.b-c@mail.example.org", "A.B-C@MAIL.example.org"]),
    "ip6": (["2001:db8::1", "2001:0DB8:0:0:0:0:0:1", "2001:DB8::0001"], ["2001:db8::2"], ["fe80::1:2a"]),
    "iban": (["DE89 3702 0044 0532 0130 00", "DE89370200440532013000"], ["GB82 WEST 1234 5698 7654 32"], ["DE88 3702 0044 0532 0130 00"]),
    "card": (["4111 1111 1111 1111", "4111111111111111"], ["4111 1111 1111 1112"]),
    "ip": (["192.168.10.1"], ["10.0.0.1"]),
    "ssn": (["123-45-6789"], ["123-45-6780"]),
    "name": (["Mrs. Çelik-Öztürk", "Frau Çelik-Öztürk"], ["Mr. J. Smith"], ["Mrs. O’Brien", "Mrs. O'Brien"], ["Mr. McDonald"], ["Dr. John Smith", "Prof. John Smith"], ["Herr Karl-Heinz Müller"], ["Mr. John Q. Public"], ["г-н Иванов"]),
}


def shape(m, kind):
    """What stays of a mention: signs, the case of letters and what is a digit; of names also the title, but not the length of given names."""
    if kind == "name":
        title, *given, family = m.split(" ")
        return title, ["I" if g.endswith(".") else "G" for g in given], shape(family, "")
    if kind == "ip":
        return m.count(".")
    if kind == "email":
        return "".join("a" if c.isalnum() else c for c in m), m.rpartition(".")[2].lower()
    return "".join("9" if c.isdigit() else "Z" if c.isupper() else "z" if c.islower() else c for c in (m if kind not in ("ip6",) else re.sub("[0-9a-f]", "0", m.lower())))


def test_every_replaced_span_has_type_format_and_identity(spark):
    """Every mention, laid into texts, is found with its type; mentions of one entity share a surrogate, different entities never do."""
    mentions = [(kind, k, m) for kind, groups in PAIRS.items() for k, g in enumerate(groups) for m in g]
    texts = [f"Zu {m}, ({m}) und\n{m}" for _, _, m in mentions]
    got = pii.replace_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k", counts=True)
    rows = {r.doc_id: r for r in got.collect()}
    canon: dict[tuple, set] = {}
    for i, (kind, k, m) in enumerate(mentions):
        r = rows[i]
        assert {t: r[f"n_{t}"] for t in pii.TYPES if r[f"n_{t}"]} == {kind: 3}, (m, r.text)
        one = regex.fullmatch(r"Zu (.+), \((.+)\) und\n(.+)", r.text)
        assert one and len(set(one.groups())) == 1, r.text
        new = one[1]
        assert new != m and shape(new, kind) == shape(m, kind), (m, new)
        assert [x[0] for x in regex.finditer(pii.ENTITY, new)] == [new], (m, new)
        if kind == "iban":
            assert new[:2] == m[:2] and (mod97(new) == 1) == (mod97(m) == 1)
        if kind == "ip6":
            left, _, right = new.partition("::")
            groups = [*filter(None, left.split(":")), *["0"] * (8 - len([*filter(None, (left + ":" + right).split(":"))])), *filter(None, right.split(":"))]
            bare = ":".join(g.lstrip("0").lower() or "0" for g in groups)
        elif kind == "phone":
            bare = re.sub(r"\D", "", re.sub(r"^\+(?:1|49|358)", "", new))
        elif kind == "name":
            bare = new.split(" ", 1)[1].lower().replace("’", "'")
        else:
            bare = re.sub(r"[ -]", "", new).lower() if kind in ("card", "iban") else new.lower()
        canon.setdefault((kind, k), set()).add(bare)
    assert all(len(v) == 1 for v in canon.values()), {k: v for k, v in canon.items() if len(v) > 1}
    assert len({(kind, *v) for (kind, _), v in canon.items()}) == len(canon)


@pytest.mark.parametrize("text", ["std::vector a::b 12:34:56", "no DE12 here", "Dr. of letters", "XY12 3", None, ""])
def test_what_is_no_entity_stays(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [tuple(r) for r in pii.replace_pii(df, "k").collect()] == [(1, text)]


# ---------------------------------------------------------------- 5


def loss(w, theta, x, y, grades, ridge):
    """The mean negative log-likelihood of P(grade >= k) = 1 / (1 + exp(theta_k - w x)), term by term, with its penalty."""
    total = 0.0
    for row, grade in zip(x, y, strict=True):
        z = float(row @ w)
        above = [1.0, *[1 / (1 + np.exp(t - z)) for t in theta], 0.0]
        total -= np.log(above[grade] - above[grade + 1])
    return total / len(y) + ridge / 2 * float(w @ w)


def test_ordinal_fit_is_a_minimum_of_its_likelihood():
    from gridflow.llm import toxicity

    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4))
    z = x @ np.array([1.5, -1.0, 0.0, 0.5]) + rng.logistic(size=300)
    y = (z[:, None] > np.array([-0.5, 0.8, 2.0])).sum(axis=1)
    w, theta = toxicity.fit_ordinal(x, y, 3)
    assert list(theta) == sorted(theta) and np.all(np.diff(theta) > 0)
    best, step = loss(w, theta, x, y, 3, 3e-4), 1e-4
    for k in range(4):
        for d in (-0.05, 0.05):
            moved = w.copy()
            moved[k] += d
            assert loss(moved, theta, x, y, 3, 3e-4) > best
        moved = w.copy()
        moved[k] += step
        assert abs(loss(moved, theta, x, y, 3, 3e-4) - best) / step < 0.01
    for k in range(3):
        for d in (-0.05, 0.05):
            moved = theta.copy()
            moved[k] += d
            assert loss(w, moved, x, y, 3, 3e-4) > best
    score = toxicity.Ordinal(["bad"], np.array([2.0]), np.array([0.5, 1.5])).score("Bad bad word, bad!")
    z = 2.0 * np.log1p(100 * 3 / 4)
    chance = [1 / (1 + np.exp(t - z)) for t in (0.5, 1.5)]
    assert np.allclose(score, (chance[0], sum(chance)))
