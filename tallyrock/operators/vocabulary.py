"""Words that place resolution knows besides the gazetteer. Pass other or longer lists to ``Vocabulary``."""

from __future__ import annotations

from dataclasses import dataclass, field

# Folded names (a-z0-9) of Romanian places in other languages, and their official names.
EXONYMS = {
    "bucharest": "București", "bukarest": "București", "bucarest": "București", "marosvasarhely": "Târgu Mureș", "csikszereda": "Miercurea Ciuc",
    "szekelyudvarhely": "Odorheiu Secuiesc", "csikszentsimon": "Sânsimion", "hermannstadt": "Sibiu", "temeswar": "Timișoara", "sighet": "Sighetu Marmației",
    "arkos": "Arcuș", "klausenburg": "Cluj-Napoca", "kolozsvar": "Cluj-Napoca", "kronstadt": "Brașov", "brasso": "Brașov", "temeschburg": "Timișoara",
    "temesvar": "Timișoara", "nagyszeben": "Sibiu", "grosswardein": "Oradea", "nagyvarad": "Oradea", "schassburg": "Sighișoara", "segesvar": "Sighișoara",
    "sepsiszentgyorgy": "Sfântu Gheorghe", "bistritz": "Bistrița", "beszterce": "Bistrița", "nagybanya": "Baia Mare", "szatmarnemeti": "Satu Mare",
    "gyulafehervar": "Alba Iulia", "karlsburg": "Alba Iulia", "resicabanya": "Reșița",
}
# Folded names of foreign places: countries and regions, then cities by country.
FOREIGN = (
    "olanda netherlands nederland tariledejos germania germany deutschland austria osterreich belgia belgium franta france italia italy spania spain portugalia portugal "
    "anglia uk unitedkingdom mareabritanie regatulunit england scotia scotland wales irlanda ireland norvegia norway suedia sweden danemarca denmark finlanda finland "
    "elvetia switzerland cehia czechia czechrepublic slovacia slovakia ungaria hungary polonia poland bulgaria grecia greece malta cipru cyprus "
    "luxemburg luxembourg luxembourgcity moldova republicofmoldova chisinau ucraina ukraine usa sua statauniteamericii canada mexic mexico cdmx mexicocity china israel "
    "emiratelearabeunite emirate qatar dubai alkuwait kuwait arabiasaudita saudiarabia turcia turkey serbia croatia slovenia estonia letonia latvia "
    "lituania lithuania republicoflithuania islanda iceland japonia japan coreea southkorea australia tanzania kenya egipt egypt maroc morocco "
    "india vietnam thailanda thailand singapore brazilia brazil "
    "amsterdam rotterdam venlo eindhoven utrecht denhaag hague thehague breda tilburg veenendaal zaltbommel losser goes arnhem rozenburg "
    "venezia venice padova padua milano milan roma rome torino turin napoli naples firenze florence bologna trieste merano vittorioveneto "
    "bratislava praha prague brno nitra dacice "
    "dresden munchen munich nurnberg nurenberg berlin hamburg frankfurt stuttgart koln cologne freiburg weingarten regensburg magdeburg "
    "dortmund erkelenz kuppenheim raunheim hofheimamtaunus altenberge gunzburg heilbronn rechlin stadthagen dingolfing hollenbach koblenz "
    "dobeln reutlingen tubingen balingen wuppertal solingen dusseldorf lubeck pinneberg flensburg leipzig hannover bielefeld salzwedel haldensleben estulgermaniei "
    "bruxelles brussels liege herstal antwerpen gent lommel colombes colombier blois frejus cannes paris lyon marseille "
    "wien vienna viena salzburg graz linz innsbruck axams badgastein lungotz wals zurich geneva bern basel glattbrugg "
    "madrid barcelona valencia sevilla benahavis lisabona lisbon porto memmartins "
    "dublin cork galway limerick belfast ashbourne meath longford tipperary roxborough cavan "
    "glasgow edinburgh cardiff leeds liverpool bristol london londra manchester birmingham slough hemelhempstead hertfordshire "
    "oslo trondheim sande bergen boden gavle stockholm goteborg gothenburg malmo copenhaga copenhagen fredericia rudkobing helsinki espoo hyvinkaa "
    "budapesta budapest abony nagykoros varsovia warsaw gdansk krakow bydgoszcz sofia plovdiv varna atena athens skalapotamias nicosia istanbul ankara "
    "foshan shanghai beijing shenzhen hangzhou shaoxing toronto montreal newyork chicago boston seattle texas dallas dallastx jacksonville jacksonvillefl "
    "grandrapids grandrapidsmi oakland paje zanzibar doha vilhena bengaluru chennai"
).split()
# Words that name no place, and those of them that only stand in for one.
PLACEHOLDERS = "romania all nespecificat remote hybrid onsite na null none tbd various altele oriunde tara strainatate international europa ue eu toate diverse variabil national".split()
JUNK = (
    "medior senior junior test street road avenue strada zona area office hq sediu sediul punct lucru deplasare central centrala nivel activitate sediulcentral europe "
    "activitatelanivelnational vasdecroaziera regiuneregiunesud robuhbucharestseimafof 2locations 4locations 13locations multiplelocations nationwide countrywide nu "
    "necunoscut unspecified unknown entry mid midlevel principal lead staff intern internship stagiu stagiar trainee fresher punctdelucru"
).split()
# Words of an address line that are no name, and those that make a part a street.
ADDRESS_WORDS = (
    "ap apt apart apartament camera cam etaj et bloc bl scara sc nr numarul strada str bulevardul bulevard bdul bd aleea calea soseaua sos intrarea intr piata drumul dr "
    "cod codpostal judetul jud comuna com satul sat orasul oras municipiul municipiu mun sectorul sector"
).split()
STREET_WORDS = "str strada stradela calea bulevardul bulevard bdul bd soseaua sos aleea piata drumul intrarea intr splaiul prelungirea".split()
# Abbreviations at a name's start (pattern, what it stands for).
ABBREVIATIONS = (
    (r"(?i)^sf\.?\s+", "sfantu "), (r"(?i)^sf\.?\s+", "sfanta "), (r"(?i)^sfv\.?\s+", "sfantu "), (r"(?i)^s\.?\s*gheorghe\z", "sfantu gheorghe"), (r"(?i)^dr\.?\s+", "doctor "), (r"(?i)^gen\.?\s+", "general "),
)
CAPITAL = "București"


@dataclass(frozen=True)
class Vocabulary:
    exonyms: dict[str, str] = field(default_factory=lambda: dict(EXONYMS))
    foreign: tuple[str, ...] = tuple(FOREIGN)
    placeholders: tuple[str, ...] = tuple(PLACEHOLDERS)
    junk: tuple[str, ...] = (*PLACEHOLDERS, *JUNK)
    street_words: tuple[str, ...] = tuple(STREET_WORDS)
