"""Countries: translation, names given by users, regions, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spanish country names with their English ones.
SPANISH_ENGLISH = {
    "ESTADOS UNIDOS": "United States", "REINO UNIDO": "United Kingdom", "PAÍSES BAJOS": "Netherlands", "ALEMANIA": "Germany", "BÉLGICA": "Belgium", "FRANCIA": "France", "ESPAÑA": "Spain", "ITALIA": "Italy",
    "PORTUGAL": "Portugal", "SUIZA": "Switzerland", "AUSTRIA": "Austria", "DINAMARCA": "Denmark", "SUECIA": "Sweden", "NORUEGA": "Norway", "FINLANDIA": "Finland", "POLONIA": "Poland", "LETONIA": "Latvia",
    "LITUANIA": "Lithuania", "ESTONIA": "Estonia", "REPÚBLICA CHECA": "Czech Republic", "HUNGRÍA": "Hungary", "RUMANIA": "Romania", "BULGARIA": "Bulgaria", "GRECIA": "Greece", "IRLANDA": "Ireland",
    "LUXEMBURGO": "Luxembourg", "ESLOVAQUIA": "Slovakia", "ESLOVENIA": "Slovenia", "CROACIA": "Croatia", "JAPÓN": "Japan", "CHINA": "China", "COREA DEL SUR": "South Korea", "COREA DEL NORTE": "North Korea",
    "TAIWÁN": "Taiwan", "TAILANDIA": "Thailand", "VIETNAM": "Vietnam", "SINGAPUR": "Singapore", "MALASIA": "Malaysia", "INDONESIA": "Indonesia", "FILIPINAS": "Philippines", "INDIA": "India",
    "AUSTRALIA": "Australia", "NUEVA ZELANDA": "New Zealand", "CANADÁ": "Canada", "MÉXICO": "Mexico", "BRASIL": "Brazil", "ARGENTINA": "Argentina", "CHILE": "Chile", "PERÚ": "Peru", "COLOMBIA": "Colombia",
    "VENEZUELA": "Venezuela", "ECUADOR": "Ecuador", "BOLIVIA": "Bolivia", "PARAGUAY": "Paraguay", "URUGUAY": "Uruguay", "COSTA RICA": "Costa Rica", "PANAMÁ": "Panama", "GUATEMALA": "Guatemala",
    "HONDURAS": "Honduras", "EL SALVADOR": "El Salvador", "NICARAGUA": "Nicaragua", "REPÚBLICA DOMINICANA": "Dominican Republic", "PUERTO RICO": "Puerto Rico", "CUBA": "Cuba", "JAMAICA": "Jamaica",
    "HAITÍ": "Haiti", "ISRAEL": "Israel", "EMIRATOS ÁRABES UNIDOS": "United Arab Emirates", "ARABIA SAUDITA": "Saudi Arabia", "EGIPTO": "Egypt", "SUDÁFRICA": "South Africa", "KENIA": "Kenya",
    "MARRUECOS": "Morocco", "RUSIA": "Russia", "UCRANIA": "Ukraine",
}
ALIASES = {"USA": "ESTADOS UNIDOS", "US": "ESTADOS UNIDOS", "UK": "REINO UNIDO", "UAE": "EMIRATOS ÁRABES UNIDOS"}
ENGLISH_SPANISH = {en: es for es, en in SPANISH_ENGLISH.items()} | ALIASES
# Countries that count as Europe.
EUROPE = (
    "Germany", "Austria", "Belgium", "Bulgaria", "Cyprus", "Croatia", "Denmark", "Slovakia", "Slovenia", "Spain", "Estonia", "Finland", "France", "Greece", "Hungary", "Ireland", "Iceland", "Italy", "Latvia", "Lithuania",
    "Luxembourg", "Malta", "Norway", "Netherlands", "Poland", "Portugal", "United Kingdom", "Czech Republic", "Romania", "Sweden", "Switzerland",
)
# Trading neighbours of European countries, nearest first.
NEIGHBOURS = {
    "Lithuania": ["Poland", "Latvia", "Estonia", "Germany", "Netherlands"], "Latvia": ["Lithuania", "Estonia", "Poland", "Germany", "Finland"], "Estonia": ["Latvia", "Lithuania", "Finland", "Sweden", "Germany"],
    "Netherlands": ["Belgium", "Germany", "France"], "Belgium": ["Netherlands", "France", "Germany", "Luxembourg"], "Luxembourg": ["Belgium", "Germany", "France"],
    "Germany": ["Poland", "Netherlands", "Belgium", "France", "Austria", "Czech Republic"], "Poland": ["Germany", "Czech Republic", "Lithuania", "Latvia"], "Czech Republic": ["Germany", "Poland", "Austria", "Slovakia"],
    "Slovakia": ["Czech Republic", "Poland", "Austria", "Hungary"], "Austria": ["Germany", "Czech Republic", "Slovakia", "Hungary", "Italy", "Switzerland"], "Switzerland": ["Germany", "France", "Italy", "Austria"],
    "Italy": ["France", "Austria", "Switzerland", "Slovenia"], "France": ["Belgium", "Luxembourg", "Germany", "Switzerland", "Italy", "Spain"], "Spain": ["France", "Portugal"], "Portugal": ["Spain"],
    "Greece": ["Bulgaria", "Romania"], "Slovenia": ["Italy", "Austria", "Croatia", "Hungary"], "Croatia": ["Slovenia", "Hungary", "Austria"], "Sweden": ["Norway", "Finland", "Denmark"],
    "Norway": ["Sweden", "Finland", "Denmark"], "Finland": ["Sweden", "Norway", "Estonia"], "Denmark": ["Germany", "Sweden", "Norway"], "Hungary": ["Austria", "Slovakia", "Romania", "Croatia", "Slovenia"],
    "Romania": ["Hungary", "Bulgaria", "Greece"], "Bulgaria": ["Romania", "Greece"], "United Kingdom": ["Ireland", "France", "Netherlands", "Belgium"], "Ireland": ["United Kingdom"],
}


def lookup(values: dict, key: Column) -> Column:
    """A constant map's value for the key, null if it has none."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), key)


def english_country(spanish: Column) -> Column:
    """English name of a Spanish one in any case; other values unchanged."""
    return F.coalesce(lookup(SPANISH_ENGLISH, F.upper(spanish)), spanish)


def region(english: Column) -> Column:
    """Europe or Rest of World; null is Rest of World."""
    return F.when(F.coalesce(english.isin(*EUROPE), F.lit(False)), "Europe").otherwise("Rest of World")


def spanish_country(name: str) -> str:
    """Spanish name of an English one as a query parameter: as given, in upper case, in title case, else the input in upper case."""
    return next((ENGLISH_SPANISH[x] for x in (name, name.upper(), name.title()) if x in ENGLISH_SPANISH), name.upper())


def country_parameter(name: str) -> str:
    """A country parameter as the data spells it: Spanish names stay, English ones are translated."""
    return name.upper() if name.upper() in SPANISH_ENGLISH else spanish_country(name)


def names_of_country(name: str) -> list[str]:
    """A country name as given, in Spanish and in English, as far as they are known."""
    return sorted({name, spanish_country(name), SPANISH_ENGLISH.get(name.upper(), name)})


def neighbour_edges(spark: SparkSession, neighbours: dict[str, list[str]] = NEIGHBOURS) -> DataFrame:
    """(country, neighbour, rank) edges: as many as the constant map has."""
    return spark.createDataFrame([(c, n, k) for c, own in neighbours.items() for k, n in enumerate(own, 1)], "country string, neighbour string, rank int")
