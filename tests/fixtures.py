"""A small gazetteer, companies and listings of our own."""

from tallyrock.operators import places

NOW = "2026-09-05T12:00:00Z"
INDEX = [
    ("clujnapoca", "Cluj-Napoca", "Cluj", "seat"), ("bucuresti", "București", "București", "seat"), ("timisoara", "Timișoara", "Timiș", "seat"), ("targumures", "Târgu Mureș", "Mureș", "seat"),
    ("sibiu", "Sibiu", "Sibiu", "seat"), ("brasov", "Brașov", "Brașov", "seat"), ("sfantugheorghe", "Sfântu Gheorghe", "Covasna", "seat"), ("campulung", "Câmpulung", "Argeș", "town"),
    ("targoviste", "Târgoviște", "Dâmbovița", "seat"), ("sanmartin", "Sânmartin", None, "village"), ("ramnicusarat", "Râmnicu Sărat", "Buzău", "town"), ("budeasa", "Budeasa", "Argeș", "village"),
    ("buteasa", "Buteasa", "Maramureș", "village"), ("2mai", "2 Mai", "Constanța", "village"), ("jucu", "Jucu", "Cluj", "village"), ("eforie", "Eforie", "Constanța", "town"),
    ("bucuresci", "Bucureșci", "Hunedoara", "village"), ("pipea", "Pipea", "Mureș", "village"), ("valcele", "Vâlcele", None, "village"), ("odorheiusecuiesc", "Odorheiu Secuiesc", "Harghita", "town"),
]
LOCALITIES = [
    ("Cluj-Napoca", "Cluj", 1, "seat", None, None), ("Câmpulung", "Argeș", 4, "town", None, None), ("Jucu", "Cluj", 22, "village", None, None), ("Târgoviște", "Timiș", 23, "village", None, None),
    ("Sânmartin", "Bihor", 22, "village", None, None), ("Sânmartin", "Cluj", 22, "village", None, None), ("Cristian", "Brașov", 22, "village", "507055", None), ("Vâlcele", "Covasna", 22, "village", "527180", ("Comuna Vâlcele", 5)),
    ("Hetea", "Covasna", 23, "village", "527180", ("Vâlcele", 5)), ("Poiana Negrii", "Suceava", 23, "village", None, ("Dorna Candrenilor", 5)), ("Gherla", "Cluj", 4, "town", None, None), ("Apahida", "Cluj", 22, "village", None, None),
]
COUNTIES = ["Alba", "Argeș", "Bihor", "Brașov", "Cluj", "Covasna", "Constanța", "Dâmbovița", "Sibiu", "Suceava", "Timiș"]
COMPANIES = [
    ("24973770", "EXEMPLU SOFT SRL", "activ"), ("RO31468843", "VECHEA FIRMĂ SA", "inactiv"), ("12345670", "FIRMA CIUDATĂ SRL", "funcțiune"), ("0024973770", "EXEMPLU VECHI SRL", "radiat"),
]
CLEAN = {
    "url": "https://www.exemplu.ro/job/1", "title": "Șofer categoria B", "company": "EXEMPLU SOFT SRL", "cif": "24973770", "location": ["Cluj-Napoca, Romania"], "tags": ["sofer", "transport"], "workmode": "on-site",
    "date": "2026-09-01T08:00:00Z", "status": "scraped", "vdate": "", "expirationdate": "", "salary": [], "salary_is_array": False,
}
SCHEMA = "url string, title string, company string, cif string, location array<string>, tags array<string>, workmode string, date string, status string, vdate string, expirationdate string, salary array<string>, salary_is_array boolean"


def gazetteer(spark):
    index = spark.createDataFrame(INDEX, "key string, name string, county string, type string")
    localities = spark.createDataFrame(LOCALITIES, "name string, county string, type int, type_label string, postal_code string, parent struct<name:string,type:int>")
    return places.build(index, localities, spark.createDataFrame([(c,) for c in COUNTIES], "name string"))


def companies(spark):
    rows = [(i, c, s, "scraper.py", "2026-09-01") for i, c, s in COMPANIES]
    return spark.createDataFrame(rows, "id string, company string, status string, scraperFile string, lastScraped string")


def listings(spark, *overrides):
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple({**CLEAN, **o}[k] for k in names) for o in overrides], SCHEMA)
