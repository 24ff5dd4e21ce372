"""Text rules as column expressions; NFKC is the one that needs a pandas UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Character ranges, symbols, patterns, key words, synonyms.
ARABIC = "[\\u0600-\\u06FF]"
PRESENTATION_FORMS = "[\\uFB50-\\uFDFF\\uFE70-\\uFEFF]"
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
CHECKBOX_ONLY = "^[\\s□☐☑✓✗\\[\\]\\(\\)\\-_]{1,5}$"
CHECKBOX_IN = "(^|\\s)(□|☐|☑|✓|✗|\\[\\s*\\]|\\(\\s*\\))(\\s|$)"
CHECKBOX_MARK = "□|☐|☑|✓|✗|\\[\\s*\\]|\\(\\s*\\)"
DATE = "[\\d٠-٩]{1,4}[/\\-.\\\\][\\d٠-٩]{1,2}[/\\-.\\\\][\\d٠-٩]{2,4}"
EMPTY_DATE = "([/\\-.\\\\]\\s*){2,}"
NUMBER = "^[\\d٠-٩.,\\s+\\-%]{1,20}$"
FRAGMENT = "^([.\\-)]?\\s*\\d+\\s*[.\\-)]?|[()\\[\\]/\\\\-]|م\\d+|\\d+م|م)$"
GHOSTS = ("^[._\\-\\s/\\\\:]+$", "^[\\s()\\[\\]]{1,2}$", "^[\\s□☐☑✓✗]{3,}$", FRAGMENT)
WIDGETS = ("text", "number", "radio", "select", "date", "datetime", "textarea", "checkbox", "repeating_rows", "signature", "nested_group", "hierarchical_table", "file", "unknown")
SYNONYMS = {
    "infection rate": "infection_rate",
    "mortality rate": "mortality_rate",
    "hand hygiene compliance": "hand_hygiene_compliance",
    "bed occupancy rate": "bed_occupancy_rate",
    "patient satisfaction": "patient_satisfaction_score",
    "readmission rate": "readmission_rate",
    "medication error rate": "medication_error_rate",
    "fall rate": "fall_rate",
    "pressure ulcer rate": "pressure_ulcer_rate",
    "surgical site infection": "ssi_rate",
    "central line infection": "clabsi_rate",
    "ventilator pneumonia": "vap_rate",
    "catheter infection": "cauti_rate",
    "sterilization compliance": "sterilization_compliance",
    "equipment failure rate": "equipment_failure_rate",
    "معدل العدوى": "infection_rate",
    "معدل الوفيات": "mortality_rate",
    "نظافة اليدين": "hand_hygiene_compliance",
    "نسبة إشغال الأسرة": "bed_occupancy_rate",
    "رضا المرضى": "patient_satisfaction_score",
    "معدل إعادة الدخول": "readmission_rate",
    "أخطاء الأدوية": "medication_error_rate",
    "معدل السقوط": "fall_rate",
    "قرحة الضغط": "pressure_ulcer_rate",
    "عدوى الموقع الجراحي": "ssi_rate",
    "عدوى القسطرة المركزية": "clabsi_rate",
    "التهاب رئوي مرتبط بالتنفس": "vap_rate",
    "عدوى القسطرة البولية": "cauti_rate",
    "امتثال التعقيم": "sterilization_compliance",
    "معدل فشل المعدات": "equipment_failure_rate",
}


def arabic_chars(text: Column) -> Column:
    return F.regexp_count(text, F.lit(ARABIC))


def latin_chars(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[A-Za-z]"))


def language(arabic: Column, latin: Column) -> Column:
    """ar, en or ar_en from counts of letters; ar without letters."""
    share = arabic / (arabic + latin)
    return F.when(arabic + latin == 0, "ar").when(share >= 0.65, "ar").when(share <= 0.30, "en").otherwise("ar_en")


def has_presentation_forms(text: Column) -> Column:
    return text.rlike(PRESENTATION_FORMS)


def looks_reversed(text: Column) -> Column:
    return has_presentation_forms(text) | text.rlike("^[ةى]")


def nfkc(text: Column) -> Column:
    """Compatibility normal form; the one text rule without a built-in function."""

    @F.pandas_udf("string")
    def fold(s):
        return s.str.normalize("NFKC")

    return fold(text)


def turned_arabic(plain: Column, reverse: Column) -> Column:
    """Words and their order turned round on reversed pages, for texts that are over 30 percent Arabic."""
    share = arabic_chars(plain) / F.greatest(F.length(plain), F.lit(1))
    turned = F.array_join(F.transform(F.reverse(F.split(plain, " ")), lambda w: F.reverse(w)), " ")
    return F.when(reverse & (share > 0.3), turned).otherwise(plain)


def fix_arabic(text: Column, reverse: Column) -> Column:
    """NFKC, then turned_arabic."""
    return turned_arabic(nfkc(text), reverse)


def widget(text: Column) -> Column:
    """The widget class of a cell's text, by ordered rules."""
    t = F.trim(text)
    low = F.lower(t)
    any_of = lambda *words: F.array_contains(F.array(*[F.contains(low, F.lit(w)) for w in words]), True)
    return (
        F.when(text.isNull() | (t == ""), "text")
        .when(t.rlike(CHECKBOX_ONLY) | t.rlike(CHECKBOX_IN), "checkbox")
        .when(t.rlike(DATE) | t.rlike(EMPTY_DATE), "date")
        .when(any_of("تاريخ", "date"), "date")
        .when(any_of("رقم", "number"), "number")
        .when(any_of("ملاحظ", "notes", "تفاصيل", "وصف"), "textarea")
        .when(F.translate(t, ARABIC_DIGITS, "0123456789").rlike(NUMBER), "number")
        .when(F.contains(t, F.lit("\n")) | (F.length(t) > 120), "textarea")
        .otherwise("text")
    )


def known_widget(name: Column) -> Column:
    return F.when(name.isin(*WIDGETS), name).otherwise("text")


def is_fragment(text: Column) -> Column:
    return F.trim(text).rlike(FRAGMENT)


def is_ghost(text: Column) -> Column:
    """Texts that are marks or left-overs, not contents of a cell."""
    out = F.coalesce(text, F.lit("")) == ""
    for g in GHOSTS:
        out |= text.rlike(g)
    return out


def label(text: Column, kind: Column) -> Column:
    """The label of a cell: its first line, else its first 80 characters; of a
    checkbox without its marks."""
    first = F.trim(F.split(text, "\n")[0])
    own = F.when(first == "", F.substring(text, 1, 80)).otherwise(first)
    bare = F.trim(F.regexp_replace(own, CHECKBOX_MARK, ""))
    return F.when(kind == "checkbox", F.when(bare == "", "اختيار").otherwise(bare)).otherwise(own)


def stable_id(*parts: Column) -> Column:
    """A content id: sha-256 over the parts, joined by a separator, nulls as such."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts]), 256)


def slug(text: Column, most: int = 30) -> Column:
    """A key made of a text: lower-case words under underscores, with a short digest."""
    body = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_")
    return F.concat(F.rtrim(F.substring(F.ltrim(body, F.lit("_")), 1, most), F.lit("_")), F.lit("_"), F.substring(F.md5(text), 1, 4))


def uuid_of(namespace: str, key: Column) -> Column:
    """A UUID from the md5 of a namespaced key."""
    h = F.md5(F.concat(F.lit(f"{namespace}:"), key))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def synonyms(labels: DataFrame, text: str = "text", pairs: dict[str, str] = SYNONYMS) -> DataFrame:
    """Adds `canonical`: of the first synonym equal to the label (lower, trimmed), else of the
    first contained in it. The table of synonyms is a literal of the plan."""
    clean = F.lower(F.trim(F.col(text)))
    exact = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[clean]
    part = F.coalesce(*[F.when(F.contains(clean, F.lit(k)), F.lit(v)) for k, v in pairs.items()])
    return labels.withColumn("canonical", F.coalesce(exact, part))


def retry_at(last: Column, attempts: Column, most: int = 5) -> Column:
    """When a failed job runs again: after 2^attempts minutes; null after the last attempt."""
    return F.when(attempts < most, last + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.pow(F.lit(2.0), attempts) * 60))


def block_text(kind: Column, title: Column, headers: Column, rows: Column) -> Column:
    """A block as text: its kind and title, its headers over a rule, and its rows, an
    array of arrays of cells. A block without title or headers has no such lines."""
    named = F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("["), F.upper(kind), F.lit("] "), title))
    ruled = F.when(F.coalesce(F.size(headers), F.lit(0)) > 0, F.concat(F.array_join(headers, " | "), F.lit("\n" + "-" * 40)))
    return F.concat_ws("\n", named, ruled, F.array_join(F.transform(rows, lambda r: F.array_join(r, " | ")), "\n"))
