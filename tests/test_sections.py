"""Section splitting of report texts (F18) and the summary pick."""

from navlens.operators import sections as SE


def run(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    secs = {r["section"]: r["content"] for r in SE.text_sections(docs).collect()}
    summ = SE.text_summary(SE.text_sections(docs)).collect()[0]["summary"]
    return secs, summ


def test_main_and_named_sections(spark):
    secs, summ = run(spark, "intro\n## Summary\n s1 \n\n### Проблемы:\np1\np2")
    assert secs == {"main": "intro", "summary": "s1", "problems": "p1\np2"}
    assert summ == "s1"


def test_repeated_section_keeps_last_and_header_without_content_is_dropped(spark):
    secs, _ = run(spark, "# Issues\nfirst\n# recommendations\n# ISSUES\nsecond")
    assert secs == {"problems": "second"}


def test_no_headers_gives_full_text_and_prefix_summary(spark):
    text = "x" * 600
    secs, summ = run(spark, text)
    assert secs == {"full_text": text} and summ == "x" * 500


def test_only_main_is_full_text(spark):
    secs, _ = run(spark, "just text\n#not a header title")
    assert list(secs) == ["full_text"]


def test_conclusions_when_summary_empty(spark):
    _, summ = run(spark, "## Summary\n\n## Выводы\nc1")
    assert summ == "c1"


def test_titles_are_prefix_free_across_sections():
    # the single-regex header classification relies on it
    from navlens.functions.text import SECTION_TITLES
    for n1, t1 in SECTION_TITLES:
        for n2, t2 in SECTION_TITLES:
            if n1 != n2:
                assert not any(b.lower().startswith(a.lower()) for a in t1 for b in t2), (n1, n2)
