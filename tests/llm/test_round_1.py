"""What the review of the first round asked for."""

from tallyforge.llm import html_extract, linededup
from tests.llm.helpers import docs, prose


def test_repeated_text_is_template_and_all_slots_are_kept(spark):
    page = "<html><body><div class='top'>All the news of the day</div><div class='one'>{a}</div><ul><li><i>Read more</i><li>{c}<li><i>Read more</i></ul><div class='two'>{b}</div><div class='end'>Written by us</div>"
    rows = [(k, f"http://h.example/{k}", page.format(a=prose(k, 60), b=prose(40 + k, 9), c=prose(80 + k, 3))) for k in range(8)]
    whole = "<article><h2>{a}</h2><p>Tell your friends</p></article>"
    rows += [(20 + k, f"http://g.example/{k}", whole.format(a=prose(k, 8))) for k in range(8)]
    out = {r.page_id: r.text for r in html_extract.html_query(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(8):
        assert out[k] == f"{prose(k, 60)} Read more {prose(80 + k, 3)} Read more {prose(40 + k, 9)}"
        assert out[20 + k] == prose(k, 8)


def test_words_of_different_vectors_are_no_template(spark):
    a, b = "alpha", "beta"
    rows = [(k, f"http://h.example/{k}", f"<body><h2>{' '.join(w for w, at in ((a, (0, 1, 2, 3, 4)), (b, (0, 1, 3, 5))) if k in at)}</h2><p>{prose(k, 30)}</p>") for k in range(8)]
    out = {r.page_id: r.text for r in html_extract.html_query(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[0] == f"alpha beta {prose(0, 30)}" and out[7] == prose(7, 30)


def test_passages_of_several_lines_go_whole(spark):
    rows = []
    for n in (2, 3, 5, 8):
        passage = "\n".join(f"passage {n} line {k} {prose(n * 10 + k, 6)}" for k in range(n))
        rows += [(n * 10 + k, f"own start {n} {k}\n{passage}\nown end {n} {k}", "en", "a") for k in range(3)]
    text = {i: t for i, t, *_ in rows}
    out = {r.doc_id: r.text for r in linededup.dedup(docs(spark, rows)).collect()}
    for n in (2, 3, 5, 8):
        assert out[n * 10] == text[n * 10]
        for k in (1, 2):
            assert out[n * 10 + k] == f"own start {n} {k}\nown end {n} {k}"
