from larder.llm.quotations import link_quotations

SCHEMA = "conv_id long, turn long, role string, text string, depth string"

CHAT = [
    (1, 0, "user", "Where is the harbour?\nAnd who keeps it?", "x"),
    (1, 1, "assistant", "> Where is the harbour?\nBehind the hills.\nYou cannot miss it.", "x"),
    (1, 2, "user", "> And who keeps it?\nDo you know?", "x"),
    (1, 3, "assistant", ">> AND who keeps it\n> Do you know?\n\n\n\n\nNo.", "x"),
    (1, 4, "user", "> behind THE hills\n> You cannot miss it!\n> Do you know?\nThank you.\n", "x"),
    (1, 5, "user", "> nobody ever said this\nStill here", "x"),
    (1, 6, "user", "> > Do you know?\n > No.\nNo.", "x"),
    (1, 7, "user", "> No.\nWhich one?", "x"),
    (2, 0, "user", "> Where is the harbour?\nOther talk", None),
    (2, 1, None, None, "x"),
    (2, 2, "user", "", "x"),
    (2, 2, "user", "", "x"),
    (None, 3, "user", "> Other talk\nx", "x"),
    (2, None, "user", "> Other talk\ny", "x"),
    (2, 4, "user", ">\n> ...\nOnly marks", "x"),
]


def by_turn(rows):
    return {(r.conv_id, r.turn): r for r in rows}


def test_links_threads_and_texts(spark):
    rows = link_quotations(spark.createDataFrame(CHAT, SCHEMA)).collect()
    assert len(rows) == len(CHAT)
    out = by_turn(rows)
    assert [out[1, t].reply_to for t in range(8)] == [None, 0, 0, 2, 1, None, 3, 6]
    assert [out[1, t].thread for t in range(8)] == [0, 0, 0, 0, 0, 5, 0, 0]
    assert [out[1, t].depth for t in range(8)] == [0, 1, 1, 2, 2, 0, 3, 4]
    assert out[1, 3].text == "No." and out[1, 4].text == "Thank you." and out[1, 4].quoted == 3
    assert out[2, 0].reply_to is None and out[2, 0].text == "Other talk"
    assert out[2, 1].text == out[2, 2].text == "" and out[2, 4].text == "Only marks"
    assert out[None, 3].reply_to is out[2, None].reply_to is None and out[2, None].depth == 0


def test_long_chains_need_few_rounds(spark):
    rows = [(9, k, "user", f"line {k}" if not k else f"> line {k - 1}\nline {k}", "x") for k in range(300)]
    out = by_turn(link_quotations(spark.createDataFrame(rows, SCHEMA)).collect())
    assert all((out[9, k].depth, out[9, k].thread, out[9, k].text) == (k, 0, f"line {k}") for k in range(300))


def test_the_latest_of_equal_lines_is_answered(spark):
    rows = [(1, k, "user", "yes", "x") for k in range(50)] + [(1, 50, "user", "> YES\nwhy", "x"), (1, 51, "user", "yes", "x")]
    out = by_turn(link_quotations(spark.createDataFrame(rows, SCHEMA)).collect())
    assert out[1, 50].reply_to == 49 and out[1, 51].reply_to is None
    assert link_quotations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sql_of_the_query_agrees_where_there_are_quotes(spark, tmp_path):
    """The given tables hold no quotes, so the query and its SQL meet on a chat that does."""
    import duckdb

    from larder.llm.queries import ORACLES, QUERIES

    rows = [r for r in CHAT if r[0] is not None and r[1] is not None and r[:2] != (2, 2)]
    rows += [(3, k, "user", f"line {k}" if k % 3 else f"> line {k - 1}\n>> line {k - 2}\n> line {k - 2}\nline {k}", "x") for k in range(30)]
    spark.createDataFrame(rows, SCHEMA).drop("depth").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    result = con.execute(ORACLES["op5_quotations"])
    names = [d[0] for d in result.description]
    want = {tuple(r[names.index(c)] for c in sorted(names)) for r in result.fetchall()}
    got = {tuple(r[c] for c in sorted(names)) for r in QUERIES["op5_quotations"](spark, str(tmp_path)).collect()}
    assert got == want and len(want) == len(rows)


def replies(spark, *texts):
    rows = [(1, k, "user", text, "x") for k, text in enumerate(texts)]
    out = by_turn(link_quotations(spark.createDataFrame(rows, SCHEMA)).collect())
    return [(out[1, k].reply_to, out[1, k].thread, out[1, k].depth) for k in range(len(texts))]


def test_deeper_levels_link_where_the_first_does_not(spark):
    chat = ("Where is the harbour?", "> Where is the harbour?\nBehind the hills.", "Other talk", ">> Where is the harbour?\nI know.")
    assert replies(spark, *chat) == [(None, 0, 0), (0, 0, 1), (None, 2, 0), (1, 0, 2)]
    assert replies(spark, *chat, ">>> where is\n>>> the harbour\nStill no.")[4] == (3, 0, 3)
    assert replies(spark, chat[0], chat[2], chat[3])[2] == (0, 0, 1)


def test_quotes_that_were_wrapped_anew(spark):
    long = "The boats came back from the strait before dawn, and nobody had counted them."
    wrapped = "The boats came back from\nthe strait before dawn,\nand nobody had counted them."
    quote = lambda text: "> " + text.replace("\n", "\n> ") + "\nIs that so?"
    for original, quoted in ((long, wrapped), (wrapped, long)):
        assert replies(spark, "Hello", original, "yes", quote(quoted)) == [(None, 0, 0), (None, 1, 0), (None, 2, 0), (1, 1, 1)]
    # Two short words, and lines without a word between.
    assert replies(spark, "yes please", "no", "> yes\n>\n> please\nGood")[2] == (0, 0, 1)


def test_a_sentence_out_of_a_longer_line(spark):
    chat = ("Good day. Do you know? Call me then.", "No idea", "> Do you know?\nI do", "Nobody knows the harbour", "> Nobody\nWho?")
    assert [r[0] for r in replies(spark, *chat)] == [None, None, 0, None, None]


def test_very_long_lines_and_texts(spark):
    marks, words = ">" * 100_000, "word " * 100_000
    rows = [(1, 0, "user", words, None), (1, 1, "user", marks + " deep", None), (1, 2, "user", "> " + words, None)]
    got = by_turn(link_quotations(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got[1, 1].text == "" and got[1, 1].quoted == 0
    assert (got[1, 2].text, got[1, 2].quoted, got[1, 2].reply_to) == ("", 1, 0)


def test_threads_in_reply_order(spark):
    rows = link_quotations(spark.createDataFrame(CHAT, SCHEMA)).collect()
    threads = {}
    for r in rows:
        if r.conv_id == 1:
            threads.setdefault(r.thread, []).append(r)
    for own in threads.values():
        own.sort(key=lambda r: r.position)
        assert [r.position for r in own] == list(range(len(own)))
        place = {r.turn: r.position for r in own}
        assert all(r.reply_to is None or place[r.reply_to] < r.position for r in own)
    assert max(map(len, threads.values())) > 2


def test_a_line_of_every_message_over_many_blocks(spark, monkeypatch):
    """A line that stands everywhere points to the latest message that has it, in its own block of turns or an earlier one."""
    monkeypatch.setattr("larder.llm.quotations.TURN_BLOCK", 2)
    rows = [(1, t, "user", "> yes\nyes" if t % 3 else "yes", None) for t in range(40)] + [(1, 100, "user", "> yes", None)]
    rows += [(2, 0, "user", "once", None), (2, 70, "user", "> once", None), (2, -9, "user", "once", None)]
    got = by_turn(link_quotations(spark.createDataFrame(rows, SCHEMA)).collect())
    assert all(got[1, t].reply_to == t - 1 for t in range(40) if t % 3)
    assert got[1, 100].reply_to == 39 and got[2, 70].reply_to == 0 and got[2, 0].reply_to is None
