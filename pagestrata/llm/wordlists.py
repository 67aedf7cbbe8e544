"""Common words of the languages the corpora hold."""

# Frequent function words of each language, in lower case.
COMMON = {
    "en": "a about after against all along although an and any are as at be because been before behind being below beside between but by can could did do does down during each every for from had has have he her here his how i if in inside into is it its like many more most much my near nearly no not of off often on once one only or our out over own she since so some such than that the their them then there these they this those through to too toward towards under until up upon us very was we were what when whenever where whereas whether which while who why will with within without would you your",
    "de": "aber alle als am an auch auf aus bei beim bis da das dass dem den denn der des die doch durch ein eine einem einen einer eines er es fast für gegen hat haben hinter ich ihr im in ist jede jeden jeder jedes keine keinen man mit nach neben nicht noch nur ob oder ohne sehr seit sich sie sind so über um und unter viele vom von vor war waren wenn wer wie wir wird zu zum zur zwischen",
    "es": "a al algo antes aunque cada casi como con cuando de del desde después donde durante el ella ellos en entre era es esta este esto están fue hace hasta hay junto la las le lo los mas me mi mucho muy ni ningún no nos o para pero por porque pues que se ser si siempre sin sobre son su sus también tan todo un una unas unos y ya",
    "fr": "à au aussi aux avant avec beaucoup car ce ces cette chaque comme dans de depuis des donc du elle elles en entre est et était il ils je jusque la le les leur leurs lui mais même ne nous on ou où par pas peu plus pour presque près qui que quand sa sans se ses si son sont sous sur toujours tout tous très trop un une vous y",
    "ru": "а без бы был была были было в вам вас весь во все вы где да для до его ее если есть ещё же за зато и из или им их к как каждый каждую ко когда кто ли мы на над не него нет но о об он она они от перед по под после потому поэтому почти при с со так там то тоже только ты у уже через что чтобы эта эти это я",
}
COMMON_SETS = {language: frozenset(words.split()) for language, words in COMMON.items()}
# Fixed value: Japanese particles and marks that running text is full of.
JAPANESE_COMMON = frozenset("はをがのにでとへもやかられたてだ、。")
# Names under which a language column may hold a language.
LANGUAGE_NAMES = {
    "en": "en eng english en_gb en_us en-gb en-us",
    "de": "de deu ger german deutsch de_de de-de",
    "es": "es spa spanish español es_es es-es",
    "fr": "fr fra fre french français fr_fr fr-fr",
    "ru": "ru rus russian русский ru_ru ru-ru",
    "ja": "ja jp jpn japanese 日本語 ja_jp ja-jp",
}
LANGUAGE_BY_NAME = {name: language for language, names in LANGUAGE_NAMES.items() for name in names.split()}
