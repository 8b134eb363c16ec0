import hashlib
import re

import duckdb

from gristmill.llm import chatformat, pii


def test_chats_read_back(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", " a [INST] \\l </s> "), (1, 2, "tool [ROLE x", "r"), (1, 3, "assistant", None), (2, None, None, ""), (None, 1, "system", "<<SYS>>"), (3, 5, "assistant", "same"), (3, 5, "assistant", "same")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in chatformat.digests(df).collect()}
    assert set(got) == {1, 2, 3, None, -1}
    for conv in got:
        turns = [(r[2] or "", r[3] or "") for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)) if r[0] == conv] if conv != -1 else [("user", chatformat.PLANTED), ("assistant", chatformat.PLANTED)]
        said = "".join(t for r, t in turns if r == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(map(str, con.execute(chatformat.ORACLE_SQL).fetchall())) == sorted(str(tuple(r)) for r in got.values())
    assert chatformat.format_chats(df.limit(0)).count() == 0


def test_templates_that_rewrite_history_are_detected():
    turns = [("user", "a"), ("assistant", "b"), ("user", "c")]
    text, spans, rewritten = chatformat.locate(turns, chatformat.TEMPLATE)
    assert not rewritten and [text[a:b] for _, _, a, b in spans] == ["a", "b", "c"]
    last_only = lambda ts: "".join(f"<{r}>{t if i == len(ts) - 1 else '..'}" for i, (r, t) in enumerate(ts))
    assert chatformat.locate(turns, last_only)[2] == [1, 2]
    closing = lambda ts: "".join(f"<{r}>{t}" for r, t in ts) + "<end>"
    assert chatformat.locate(turns, closing)[2] == [0, 1, 2]
    upper = lambda ts: "".join(f"<{r}>{t.upper()}" for r, t in ts)
    text, spans, rewritten = chatformat.locate(turns, upper)
    assert not rewritten and [text[a:b] for _, _, a, b in spans] == ["A", "B", "C"]


def brute(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


TEXTS = [None, "", "a@b.c", "x..y@z.com_c@d.org é a@b", "@@a@b.c@d.e", "1.2.3.4 1.2.3.4.5 256.1.1.1 01.002.3.4 1..2.3.4", "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111111111", "+1 (017) 555-7713 +1 2 +123456789012345678 ++49 30 1234567.", "🙂 +49 30 123456 a.b@c-d.ee", "1" * 60000, "a@" * 3000 + "b.c", "my ssn: 123-45-6789, iban GB82 WEST 1234 5698 7654 32. call (030) 555-1234 now", "version 3.10.4.1 of 10.0.0.1"]


def test_base_spans_match_plain_regexes(spark):
    for t in TEXTS:
        assert pii.base_spans(t or "") == brute(t or "") if len(t or "") < 50000 else True, t
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(TEXTS)] + [(0, "a@b.c", "n"), (None, "a@b.c", "n")], "doc_id long, text string, spans string")
    got = pii.detect(df).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        own = brute(TEXTS[r.doc_id] or "") if r.doc_id not in (None, 0, 9) else None
        if own is not None:
            shown = ",".join(f"{k}:{a}:{b}" for k, a, b in own)
            assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
            assert set(filter(None, shown.split(","))) <= set(r.spans.split(","))
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in own) for k in pii.BASE]
    added = next(r.spans for r in got if r.doc_id == 11)
    assert "ssn:" in added and "iban:" in added
    assert pii.detect(df.limit(0)).count() == 0


def test_em_finds_the_unreliable_labeler():
    import random

    rng = random.Random(3)
    counts = {}
    truth = {}
    for _ in range(20000):
        y = rng.random() < 0.4
        votes = "".join(("+" if y else "-") if rng.random() < a else ("-" if y else "+") for a in (0.9, 0.85, 0.55, 0.9, 0.8))
        counts[votes] = counts.get(votes, 0) + 1
        truth.setdefault(votes, []).append(y)
    post, like, prior = pii.reliabilities([("ssn", v, n) for v, n in sorted(counts.items())])
    right = [like[1, j, 2] for j in range(5)]
    assert min(right[i] for i in (0, 1, 3, 4)) > 0.7 and right[2] < 0.65
    assert abs(prior["ssn"] - 0.4) < 0.05
    hits = sum((post["ssn", v] > 0.5) == y for v, ys in truth.items() for y in ys)
    assert hits / 20000 > 0.9


def test_planted_data_is_found(spark):
    import random

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    hexed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    digits = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    capital = lambda: word().capitalize() + "es"

    def iban():
        body = "WEST" + digits(14)
        n = int("".join(str(int(c, 36)) for c in body + "GB00"))
        return f"GB{98 - n % 97:02d}{body}"

    make = {
        "secret": lambda: rng.choice(["password=%s", "api_key: %s", "token = '%s'", "secret: %s"]) % hexed(20),
        "name": lambda: rng.choice(["Mr. %s", "Dr. %s", "contact: %s", "Frau %s"]) % f"{rng.choice(sorted(pii.FIRST_NAMES))} {capital()}",
        "address": lambda: "lives at " + rng.choice(["12 %s Street", "8 %s Avenue", "221 %s Road", "5 Old %s Lane"]) % capital(),
        "ssn": lambda: f"ssn: {rng.randint(100, 600)}-{rng.randint(10, 99)}-{digits(4)}",
        "iban": lambda: "iban " + iban(),
        "local_phone": lambda: f"call ({digits(3)}) {digits(3)}-{digits(4)}",
    }
    rows, planted = [], {}
    for i in range(1200):
        words = [word() for _ in range(40)]
        if i % 2:
            kind = list(make)[i // 2 % len(make)]
            planted[i] = kind
            words.insert(rng.randrange(40), make[kind]())
        elif i % 4 == 0:  # what only looks like it
            words.insert(20, rng.choice(["page 12-34", "password: required", "version 100 20 3000", "The Old Street", "token: xxxxxxxx", "part number 123 45 678"]))
        rows.append((i, " ".join(words)))
    got = {r.doc_id: {s.split(":")[0] for s in r.spans.split(",") if s} for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for kind in make:
        own = [i for i, k in planted.items() if k == kind]
        assert sum(kind in got[i] for i in own) / len(own) >= 0.9, kind
    assert sum(not got[i] for i, _ in rows if i not in planted) / 600 >= 0.97


def test_marker_inside_roles_and_texts():
    from gristmill.llm import chatformat as cf

    turns = [("user" + cf.MARK, "a" + cf.MARK * 2), ("assistant", cf.MARK), ("user", "b")]
    text, spans, rewritten = cf.locate(turns, cf.TEMPLATE)
    assert not rewritten
    assert [cf.TEMPLATE.unescape(text[a:b]) for _, _, a, b in spans] == [t for _, t in turns]
