"""Three invented notes with gold spans, and what the offline extractor makes of them."""

NAMES = ["Ada Birch", "Tom Reed", "Lena Fox"]

NOTES = {
    "N1": "Visit of Ada Birch (MRN: 55-8812) on 2031-04-02.\nLives at 12 Elm Row, Northam. Phone 555-201-3344.\nAda Birch is a 93-year-old. Mail ada@birch.example.org.\n",
    "N2": "Seen by Tom Reed on 3/4/2031. Next call (555) 201-7788.\n",
    "N3": "No identifiers here but Lena Fox, and Westbrook Hall.\n",
}

#: literal, category: gold is every occurrence.
GOLD = {
    "N1": [("Ada Birch", "01_NAME"), ("55-8812", "09_MEDICAL_RECORD_NUMBER"), ("2031-04-02", "03_DATE"), ("12 Elm Row, Northam", "02_GEOGRAPHIC_SUBDIVISION"), ("555-201-3344", "05_TELEPHONE_NUMBER"), ("93-year-old", "04_AGE_OVER_89"), ("ada@birch.example.org", "07_EMAIL_ADDRESS")],
    "N2": [("Tom Reed", "01_NAME"), ("3/4/2031", "03_DATE"), ("(555) 201-7788", "05_TELEPHONE_NUMBER")],
    "N3": [("Lena Fox", "01_NAME"), ("Westbrook Hall", "02_GEOGRAPHIC_SUBDIVISION")],
}


def starts(text, literal):
    return [i for i in range(len(text)) if literal and text.startswith(literal, i)]


def gold_rows():
    for doc, pairs in GOLD.items():
        spans = sorted((i, i + len(lit), code) for lit, code in pairs for i in starts(NOTES[doc], lit))
        for n, (a, b, code) in enumerate(spans):
            yield doc, n, a, b, code


def frames(spark):
    notes = spark.createDataFrame(list(NOTES.items()), "doc_id string, text string")
    gold = spark.createDataFrame(list(gold_rows()), "doc_id string, span_no int, start int, end int, code string")
    docs = spark.createDataFrame([(k, len(v)) for k, v in NOTES.items()], "doc_id string, n_chars int")
    return notes, docs, gold
