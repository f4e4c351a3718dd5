"""Chat formatting, fill-in-middle and vector codes against brute force, and on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict
from itertools import pairwise

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import chat, fill_middle, vector_codes
from graphloom.llm.common import table


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# -- 11 chat formatting

ODD = ["", "\\", "\\\\", "</turn>", "</turn>\n", "\\</turn>\n### User: x", "### Assistant: hi", "#### User: a", "<</turn>", "</turn", "### =a: b", "é漢\U0001f600\n", "a\nb: c\\", "x" * 3000]
TURNS = "conv_id long, turn long, role string, text string"


def brute_chat(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns = [t[2:] for t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        moves = [a + ">" + b for a, b in pairwise(["start", *(r for r, _ in turns)])]
        good = {"start>system", "start>user", "system>user", "user>assistant", "assistant>user", "assistant>tool", "tool>tool", "tool>assistant"}
        bad = next((k + 1 for k, m in enumerate(moves) if m not in good), None)
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), bad, turns[-1][0] == "assistant")
    return out


def chat_of(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.first_bad_turn, r.complete) for r in df.collect()}


def odd_turns():
    rng, rows = random.Random(5), []
    for conv in [None, *range(30)]:
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, None, 3]), rng.choice(["user", "assistant", "system", "tool", "user", "assistant", "narrator", "### =x: y", "Assistant", "", None]), rng.choice([*ODD, None])))
    return rows + rows[:5] + [(99, k, "user" if k % 2 == 0 else "assistant", f"turn {k} </turn>") for k in range(1500)]


@pytest.mark.parametrize(("block", "most"), [(256, 1 << 20), (4, 50)])
def test_chat_is_read_back(spark, monkeypatch, block, most):
    rows = odd_turns()
    df = spark.createDataFrame(rows, TURNS).withColumns({"block": F.lit(1), "piece": F.lit("x"), "formatted": F.lit(None).cast("string")})
    pieces = chat.format_turns(df, block=block, piece_chars=most)
    assert chat_of(chat.read_pieces(pieces)) == brute_chat(rows)
    sizes = pieces.select(F.max("n_turns").alias("n")).first()
    assert sizes.n <= block
    monkeypatch.setattr(chat, "MOST_LONG", 0 if block == 4 else 10)
    assert chat_of(chat.read_back(df, block=block, piece_chars=most)) == brute_chat(rows)


def test_chat_output_shows_no_control_string_of_a_text(spark):
    t = chat.Template()
    for text in [*ODD, *(a + b for a in ODD for b in ODD)]:
        formatted = "".join(x for x, _ in t.segments("user", text)) * 2
        assert list(t.read(formatted)) == [("user", text)] * 2
        bare = re.sub(r"(?s)\\.", "\x00", formatted)
        assert bare.count("</turn>") == 2 and bare.count("### User:") == 2 and "### Assistant:" not in bare


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="\\#</turn>:= aUsé\n", max_size=12), st.text(alphabet="\\#</turn>: =User\n", max_size=40)), max_size=5))
def test_any_turns_come_back(turns):
    t = chat.Template()
    assert list(t.read("".join(x for role, text in turns for x, _ in t.segments(role, text)))) == turns


def test_templates_that_cannot_be_read_are_refused():
    for wrong in ({"end": " "}, {"escape": "##"}, {"headers": {"a": "## ", "b": "## b"}}, {"end": ":x"}):
        with pytest.raises(ValueError):
            chat.Template(**wrong)
    other = chat.Template(moves={("start", "q"): "asked", ("asked", "a"): "told"}, headers={"q": "[Q] ", "a": "[A] "}, other="[? ", after_other="] ", end="|\n", escape="^", learnt=frozenset({"a"}), finals=frozenset({"told"}))
    turns = [("q", "[A] ^ | x|\n"), ("a", "]"), ("z] ", "[? ")]
    assert list(other.read("".join(x for r, t in turns for x, _ in other.segments(r, t)))) == turns


def test_chat_of_nothing(spark):
    out = chat.read_pieces(chat.format_turns(spark.createDataFrame([], TURNS)))
    assert out.collect() == [] and "first_bad_turn" in out.columns


def test_chat_query(spark, data):
    rows = [tuple(r) for r in table(spark, data, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert chat_of(chat.op11_chat_format(spark, data)) == brute_chat([*rows, (-7, 0, "user", chat.TRAP[1]), (-7, 1, "assistant", chat.TRAP[1])])


# -- 12 fill-in-middle

MARKS = ["<P>", "has <S> inside", "a <M>", "< P>", "<", "<P", "<<S", "one two  three\n\nfour \t", "  ", "word", "a<\nb>c <M d", "é 漢字\u00a0x \U0001f600 y z"]


def brute_fim(doc_id, text, seed=42):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = sha(f"{seed}:" + ("" if doc_id is None else str(doc_id)))
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", text, None, None
    form = "spm" if h[3] % 100 < 80 else "psm"
    return n, form, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def test_fill_in_middle(spark, odd_docs, no_docs):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(["a", "<", "P>", "<S", ">", " ", "\n", "wörd", "<M"]) for _ in range(rng.randrange(40)))) for i in range(400)]
    rows += [(1000 + i, t) for i, t in enumerate(MARKS)] + [(None, "one two three four"), (5, None), (7, "twice here"), (7, "twice here"), (-3, "minus three words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd_docs.select("doc_id", "text")).withColumns({"units": F.lit(1), "id": F.lit(2), "h": F.lit("x"), "form": F.lit(None).cast("string")})
    out = fill_middle.fill_in_middle(df)
    back = out.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    given = df.select("doc_id", "text").collect()
    key = lambda r: tuple((x is not None, x) if x is not None else (False, "") for x in r)
    want = sorted(((d, t or "", *brute_fim(d, t)) for d, t in given), key=lambda r: key(map(str, r)))
    got = sorted(((r.doc_id, r.back, r.n, r.form, r.output, r.prefix_chars, r.middle_chars) for r in back), key=lambda r: key(map(str, r)))
    assert got == want
    assert {r.form for r in back} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(no_docs).collect() == []


def test_sentinels_that_overlap_are_refused():
    for marks in (("<P>", "<P>x", "<M>"), ("aa", "b", "c"), ("xy", "yz", "c"), ("", "b", "c")):
        with pytest.raises(ValueError):
            fill_middle.Sentinels(*marks)
    assert fill_middle.Sentinels("[[p", "[[s", "[[m").all()[0] == "[[p"


def test_fim_query(spark, data):
    want = sorted((d, *(x if k != 2 else sha(x) for k, x in enumerate(brute_fim(d, t))), sha(t or "")) for d, t in table(spark, data, "documents").select("doc_id", "text").collect())
    got = sorted((r.doc_id, r.n, r.form, r.output_sha256, r.prefix_chars, r.middle_chars, r.restored_sha256) for r in fill_middle.op12_fill_in_middle(spark, data).collect())
    assert got == want


# -- 13 vector codes


def brute_codes(rows, parts=16, entries=64, rounds=2):
    """Codes in Python's integers: {place in order: (id, code, error, label)} and the digest of the codebooks."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = next((len(v) for _, v, _ in kept if v and len(v) % parts == 0), 0)
    kept = [r for r in kept if len(r[1]) == dim and dim]
    d = dim // parts
    cut = [[v[p * d : (p + 1) * d] for p in range(parts)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda: [[min((far(c[p], e), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        own = defaultdict(list)
        for c, best in zip(cut, near(), strict=True):
            for p, (_, k) in enumerate(best):
                own[p, k].append(c[p])
        for (p, k), members in own.items():
            books[p][k] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    out = [(r[0], "".join(f"{k:02x}" for _, k in best), sum(e for e, _ in best), r[2]) for r, best in zip(kept, near(), strict=True)]
    return out, sha(",".join(str(x) for book in books for e in book for x in e))


VECTORS = "vec_id long, embedding array<float>, label int"


def codes_of(df, **kinds):
    books = vector_codes.Codebooks(df, **kinds)
    coded = vector_codes.with_label_errors(books.encode(df, ("label",)))
    return sorted(coded.collect(), key=str), books.digest()


def with_sums(rows):
    total = defaultdict(int)
    for _, _, error, label in rows:
        total[label] += error
    return sorted([(i, code, error, label, total[label]) for i, code, error, label in rows], key=str)


def test_vector_codes_are_exact(spark):
    rng = np.random.default_rng(1)
    coarse = (rng.integers(-3, 4, (150, 32)) / 256).astype(np.float32)  # many equal distances
    fine = rng.normal(0, 3, (150, 32)).astype(np.float32)
    large = (rng.normal(0, 1000, (40, 32)) * 40).astype(np.float32)  # beyond what float32 products hold exactly
    rows = [(int(i) % 260, v.tolist(), int(i) % 4 or None) for i, v in enumerate(np.concatenate([coarse, fine, large]))]
    rows += [(5000, None, 1), (5001, [float("nan")] * 32, 1), (5002, [1.0] * 31 + [float("inf")], 2), (5003, [None] + [1.0] * 31, 2), (None, [0.5] * 32, None), (0, [0.1] * 16, 7), (1, [], 7), (5004, [0.1] * 31, 7)]
    rows += [rows[3]] * 3
    df = spark.createDataFrame(rows, VECTORS).withColumns({"_label": F.lit(1), "c0": F.lit(2), "error": F.lit("x"), "entry": F.lit(0)})
    # the 16 components of id 0 come first by id: that length is the tables' then
    got, digest = codes_of(df)
    want, digest_of = brute_codes([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows])
    assert [(r.vec_id, r.code, r.error, r.label, r.label_error) for r in got] == [r for r in with_sums(want)] and digest == digest_of
    rest = [r for r in rows if r[1] is None or len(r[1]) == 32]
    got, digest = codes_of(spark.createDataFrame(rest, VECTORS).repartition(7))
    want, digest_of = brute_codes([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rest])
    assert sorted(((r.vec_id, r.code, r.error, r.label, r.label_error) for r in got), key=str) == with_sums(want) and digest == digest_of


def test_screening_never_loses_the_nearest():
    rng = np.random.default_rng(2)
    for size in (2, 300, 1 << 13, 1 << 25):
        x, books = rng.integers(-size, size + 1, (3, 500, 5)), rng.integers(-size, size + 1, (3, 40, 5))
        books[:, 20:] = books[:, :20]  # every entry twice
        books[0, 5] = x[0, 7] + 1
        far = ((x[:, :, None, :] - books[:, None, :, :]) ** 2).sum(axis=3)
        best, gaps = vector_codes.nearest(x, books)
        assert (best == far.argmin(axis=2)).all() and (gaps == far.min(axis=2)).all()


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame([(3, [0.25] * 16, None), (1, [-0.001] * 16, None)], VECTORS)
    got, digest = codes_of(few)
    want, digest_of = brute_codes([(3, [0.25] * 16, None), (1, [float(np.float32(-0.001))] * 16, None)])
    assert [tuple(r) for r in got] == [(i, label, code, error, total) for i, code, error, label, total in with_sums(want)] and digest == digest_of
    for rows in ([], [(1, None, 2)], [(1, [1.0] * 15, 2)]):
        got, digest = codes_of(spark.createDataFrame(rows, VECTORS))
        assert got == [] and digest == sha("")
    with pytest.raises(Exception, match="can't be coded"):
        codes_of(spark.createDataFrame([(1, [1e30] * 16, 2)], VECTORS))
    books = vector_codes.Codebooks(few)
    assert books.decode(books.encode(few).where("vec_id = 3").first().code).tolist() == [64] * 16


def test_label_sums_without_broadcast(spark, monkeypatch):
    coded = spark.createDataFrame([(1, None, 5), (2, None, 6), (3, 4, 7)], "vec_id long, label int, error long")
    for most in (10, 0):
        monkeypatch.setattr(vector_codes, "MOST_LABELS", most)
        assert sorted((r.vec_id, r.label_error) for r in vector_codes.with_label_errors(coded).collect()) == [(1, 11), (2, 11), (3, 7)]


def test_codes_query(spark, data):
    rows = [(r.vec_id, r.embedding, r.label) for r in table(spark, data, "embeddings").collect()]
    want, digest = brute_codes(rows)
    got = vector_codes.op13_vector_codes(spark, data).collect()
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in got) == sorted((i, c, e, t) for i, c, e, _, t in with_sums(want))
    assert {r.codebooks_sha256 for r in got} == {digest}


# -- faults of earlier operators


def test_a_slash_closes_no_html_element():
    from graphloom.llm import html_extract

    text = lambda page: [x for x, template, _ in html_extract.blocks(page) if not template]
    assert text('<p>one</p><script src=/a/b/>alert("leak")</script><style/>p { }</style><textarea/>typed</textarea><p>two</p>') == ["one", "two"]
    assert text("<nav/>Home About</nav><p>text</p>") == ["text"]
    assert text("<p>a<br/>b<img src=x />c</p><svg/><p>d <math><mi/>x</math> e</p>") == ["a b c", "d x e"]


def test_dotted_tokens_are_one_secret(spark):
    from graphloom.llm import pii

    token = "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.eyJzdWIiOiIxMjM0NTY3ODkwIiwibmFtZSI6IkpvaG4gRG9lIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U"
    texts = [f"Authorization: Bearer {token}", f"we sent {token}. Then", f'token = "{token}"', f"the cookie {token}, of yesterday", "plain words and eyJ alone"]
    found = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), pii.fit(spark))
    spans = {r.doc_id: r.s for r in found.select("doc_id", F.expr(pii.written("spans")).alias("s")).collect()}
    for k, text in enumerate(texts[:4]):
        start = text.index("eyJ")
        assert f"secret:{start}:{start + len(token)}" in spans[k].split(","), (text, spans[k])
    assert spans[4] == ""
