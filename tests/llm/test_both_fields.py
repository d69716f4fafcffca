"""Queries that owe their result for two fields of the messages."""

from runeframe.llm import catalogue


def write_messages(spark, folder, data):
    columns = ("body", "extra", "author")
    spark.createDataFrame([(i, *(r.get(c) for c in columns)) for i, r in enumerate(data)], "id long, body string, extra string, author string").write.parquet(f"{folder}/messages.parquet")
    spark.createDataFrame([("brisco", "Brisco Oakenfurl"), ("bot-x", None)], "author string, full_name string").write.parquet(f"{folder}/members.parquet")
    return str(folder)


def test_clean_text_of_body_and_extra(spark, rows, tmp_path):
    d = write_messages(spark, tmp_path, [{"body": "<b>x</b>", "extra": "{Embed}\n<i>soft</i> &amp; **bold**"}, {"body": "plain", "extra": "{Attachments}\nhttps://x.example/a_b/c_d.png"}, {"extra": ""}])
    assert rows(catalogue.p2_clean(spark, d)) == sorted(
        [(0, "body", "x"), (0, "extra", "{Embed}\nsoft & bold"), (1, "body", "plain"), (1, "extra", "{Attachments}\nhttps://x.example/a_b/c_d.png"), (2, "body", None), (2, "extra", "")], key=repr
    )


def test_redacted_body_and_author(spark, rows, tmp_path):
    d = write_messages(spark, tmp_path, [{"body": "mail a@b.example", "author": "Brisco Oakenfurl"}, {"body": "runes 5 12 24", "author": " OWL48@fox.example (pinned)"}, {"author": "+1-821-555-0146"}, {"body": "", "author": "harp98"}, {}])
    assert rows(catalogue.p4_redacted(spark, d)) == sorted(
        [(0, "body", "mail [EMAIL]"), (0, "author", "[PERSON_NAME]"), (1, "body", "runes 5 12 24"), (1, "author", " [EMAIL] (pinned)"), (2, "body", None), (2, "author", "[PHONE]"), (3, "body", ""), (3, "author", "harp98"), (4, "body", None), (4, "author", None)], key=repr
    )
