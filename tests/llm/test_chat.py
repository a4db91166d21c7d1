import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from sparvane.llm import chat
from sparvane.llm.queries import PROBE, tokenizer_path


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<|\\n\n>ab", max_size=14))
def test_escapes_are_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


def test_read_back(spark):
    long = "long <|im_start|> text\n" * 20_000
    rows = [(5, 0, "user", long), (5, 1, "assistant", long), (5, 1, "assistant", long), (-1, 7, "assistant", "a row of its own"), (1, 2, "assistant", "second"), (1, 1, "user", PROBE), (1, 1, "user", PROBE), (1, 3, "assistant", None), (None, None, None, None), (2, 0, "assistant", PROBE + "\\<\\|é\U0001f600\n"), (3, 0, "a\nb<|", "x")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, ids int")
    assert len(rows) == 11
    out = {r.conv_id: r for r in chat.digests(chat.format_chat(df, tokenizer_path()), tokenizer_path()).collect()}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0))
    assert set(out) == {r[0] for r in rows}
    for conv, r in out.items():
        own = [(x[2] or "", x[3] or "") for x in order if x[0] == conv]
        said = "".join(t for role, t in own if role == "assistant")
        assert r.n_turns == len(own) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert r.loss_chars == len(said) and r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_places_are_prefix_sums(spark):
    df = spark.range(500).selectExpr("id % 3 as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "repeat('word ', int(id % 5)) as text")
    by = {}
    for r in sorted(chat.format_chat(df, tokenizer_path()).collect(), key=lambda r: (r.conv_id, r.start)):
        assert r.start == by.get(r.conv_id, 0) and r.start <= r.loss_start <= r.loss_end <= r.start + len(r.ids)
        by[r.conv_id] = r.start + len(r.ids)


def test_a_conversation_over_many_partitions(spark):
    """Ties of turn and role go on by text, wherever the ranges are cut."""
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        df = spark.range(4000).selectExpr("if(id % 3 = 0, 9, id % 5) as conv_id", "cast(id / 40 as long) as turn", "'assistant' as role", "concat('same beginning of many a text here ', id) as text")
        formatted = chat.format_chat(df, tokenizer_path()).collect()
        out = {r.conv_id: r for r in chat.digests(chat.format_chat(df, tokenizer_path()), tokenizer_path()).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", True)
    by = {}
    for r in sorted(formatted, key=lambda r: (r.conv_id, r.start)):
        assert r.start == by.get(r.conv_id, 0)
        by[r.conv_id] = r.start + len(r.ids)
    for conv, r in out.items():
        own = [x.text for x in sorted(df.collect(), key=lambda x: (x.turn, x.text)) if x.conv_id == conv]
        assert r.n_turns == len(own) and r.loss_sha256 == hashlib.sha256("".join(own).encode()).hexdigest()


def test_no_rows(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_chat(df, tokenizer_path()), tokenizer_path()).count() == 0


def test_null_turns_come_first_in_the_query_and_its_sql(spark, tmp_path):
    import duckdb

    from sparvane.llm import queries

    rows = [(1, 2, "user", "b"), (1, None, "assistant", "a"), (1, 1, "assistant", None), (1, None, None, "c"), (2, None, "assistant", "x"), (2, 0, "assistant", "y")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"file://{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    result = con.execute(queries.OP6_SQL)
    names = [d[0] for d in result.description]
    want = sorted(tuple(dict(zip(names, r, strict=True))[c] for c in sorted(names)) for r in result.fetchall())
    got = queries.op6_chat(spark, f"file://{tmp_path}")
    assert sorted(tuple(r[c] for c in sorted(names)) for r in got.collect()) == want
    assert {r.conv_id: r.loss_sha256 for r in got.collect()}[2] == hashlib.sha256(b"xy").hexdigest()
