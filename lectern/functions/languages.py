"""The languages a text can be read in, with length budgets, and the marks by which a language is told."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Codes, English names and scripts, in the order in which ties are broken.
LANGUAGES = (
    ("en", "English", "latin"), ("zh", "Simplified Chinese", "cjk"), ("zh-Hant", "Traditional Chinese", "cjk"),
    ("ja", "Japanese", "cjk"), ("ko", "Korean", "hangul"), ("es", "Spanish", "latin"), ("fr", "French", "latin"),
    ("de", "German", "latin"), ("pt", "Portuguese", "latin"), ("it", "Italian", "latin"), ("ru", "Russian", "cyrillic"),
    ("hi", "Hindi", "devanagari"), ("sv", "Swedish", "latin"), ("da", "Danish", "latin"),
    ("nb", "Norwegian Bokmål", "latin"), ("fi", "Finnish", "latin"), ("nl", "Dutch", "latin"), ("pl", "Polish", "latin"),
    ("cs", "Czech", "latin"), ("uk", "Ukrainian", "cyrillic"), ("tr", "Turkish", "latin"), ("id", "Indonesian", "latin"),
    ("vi", "Vietnamese", "latin"), ("th", "Thai", "thai"),
)
# Budgets by script: takeaway, reason, topic, section, unit of length.
BUDGETS = {
    "cjk": (28, 50, 6, 32, "characters"), "thai": (80, 130, 18, 90, "characters"), "hangul": (12, 22, 3, 14, "words"),
    "vi": (24, 40, 6, 27, "words"), "other": (16, 26, 4, 18, "words"),
}
# Fixed values, as results must agree to the letter: word lists and character lists that decide a text's language.
#: Small words by which Latin languages are told, in the order in which ties are broken.
SMALL_WORDS = {
    "en": "the of and to in is that for with as on are this by be it from at or an which we not",
    "es": "de la que el en los del las por un una para con es se no al lo como más pero sus",
    "fr": "de la le les des et en du un une est que pour dans qui au sur par pas plus ne se",
    "de": "der die und den das ist nicht von zu mit des sich dem ein eine auf für im auch werden wird",
    "pt": "de que não uma para com os das dos do da em um por mais como ao se na no é são",
    "it": "di che il la per non una con del della le gli sono è nel alla più dei anche al",
    "nl": "de het een van en in is dat op te zijn voor met niet die aan er ook als",
    "sv": "och att det som en på är av för med till den har de inte om ett var jag men",
    "da": "og at det som en på er af for med til den har de ikke om et var jeg efter",
    "nb": "og at det som en på er av for med til den har de ikke om et var jeg etter å",
    "fi": "ja on ei se että oli ovat kuin mutta tai joka myös sekä tämä niin jos kun ole voi hän",
    "pl": "i w się na nie z do jest to że o jak ale za co od po przez dla są",
    "cs": "a v se na je že to s z do o jako ale pro které jsou by i za ve",
    "tr": "ve bir bu da de için ile olarak daha çok gibi olan en ama ya her kadar sonra değil",
    "id": "yang dan di dari ini itu dengan untuk dalam tidak pada adalah ke akan juga atau oleh",
}
SIMPLIFIED = "这们个来时说为国学会对发经过还体关与点实现机开长间问题种后业应进动产让认设计资数据级统处务将东区场结构变标准条网络语历层万号"
TRADITIONAL = "這們個來時說為國學會對發經過還體關與點實現機開長間問題種後業應進動產讓認設計資數據級統處務將東區場結構變標準條網絡語歷層萬號"
VIETNAMESE = "ạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹđơư"


def languages(spark: SparkSession) -> DataFrame:
    """code, name, script, takeaway, reason, topic, section, unit, stop: one row a language."""
    rows = []
    for code, name, script in LANGUAGES:
        budget = BUDGETS["vi" if code == "vi" else script if script in BUDGETS else "other"]
        rows.append((code, name, script, *budget, "。" if script == "cjk" else "।" if script == "devanagari" else "."))
    return spark.createDataFrame(
        rows, "code string, name string, script string, takeaway int, reason int, topic int, section int, unit string, stop string"
    )
