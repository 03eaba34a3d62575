"""Every operator on odd rows and on empty tables."""

import pytest

from recordaudit.llm import counts, fingerprints, language, maxent, media, mixing, packing, quality, simhash, toxicity, warc
from tests.llm.conftest import ODD


def labels_of(spark, n=10):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(n)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "counts": lambda d: counts.count_edits(d, counts.usual_edits()),
    "language": language.identify,
    "simhash": simhash.near_duplicates,
    "media": lambda d: media.digest_media(media.encode_media(d)),
    "fingerprints": fingerprints.fingerprint_edits,
    "quality": lambda d: quality.score_quality(d, labels_of(d.sparkSession)),
    "toxicity": lambda d: toxicity.score_toxicity(d, labels_of(d.sparkSession)),
    "mixing": lambda d: mixing.mix(d).documents,
    "packing": packing.pack,
    "maxent": lambda d: maxent.score_texts(d, updates=1),
    "warc": lambda d: warc.digest_pages(d.selectExpr("doc_id AS page_id", "source AS url", "text AS html", "1 AS length")),
    "keep identified": language.keep_identified,
    "keep good": lambda d: quality.keep_good(d, labels_of(d.sparkSession)),
    "keep first": simhash.keep_first,
    "mixed documents": mixing.mixed_documents,
}
PER_ROW = set(OPERATORS) - {"packing", "keep identified", "keep good", "keep first", "mixed documents"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(docs, name):
    df = docs(ODD, clash=True)
    rows = OPERATORS[name](df).collect()
    if name in PER_ROW:
        assert len(rows) == len(ODD)
        key = "page_id" if name == "warc" else "doc_id"
        assert sorted(str(r[key]) for r in rows) == sorted(str(r[0]) for r in ODD)
    if name.startswith(("keep", "mixed")):
        assert set(rows[0].asDict() if rows else df.columns) == set(df.columns)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(docs, name):
    assert OPERATORS[name](docs([])).collect() == []
