"""Short dictionaries of public names. Longer ones are parameters: any DataFrame (term, kind, boost) takes their place."""

from __future__ import annotations

CITIES = {
    "capital": "Berlin|Paris|Madrid|Rome|London|Vienna|Tokyo|Ottawa|Lisbon|Dublin|Warsaw|Prague|Athens|Oslo|Stockholm|Helsinki|Brussels|Amsterdam|Bern|Cairo|Delhi|Beijing|Seoul|Canberra|Wellington|Nairobi|Pretoria|Lima|Bogota|Santiago|Buenos Aires|Mexico City",
    "american": "New York|Los Angeles|Chicago|Houston|Phoenix|Philadelphia|San Antonio|San Diego|Dallas|Austin|Seattle|Denver|Boston|Portland|Springfield|Toronto|Montreal|Vancouver|Calgary|Winnipeg|Atlanta|Miami|Detroit|San Francisco",
    "other": "Munich|Hamburg|Cologne|Frankfurt|Lyon|Marseille|Barcelona|Valencia|Seville|Milan|Naples|Turin|Manchester|Birmingham|Glasgow|Edinburgh|Osaka|Kyoto|Mumbai|Chennai|Shanghai|Sydney|Melbourne|Johannesburg|Sao Paulo|Rotterdam|Zurich|Geneva|Porto",
}
CITY_BOOST = {"capital": 0.15, "american": 0.12, "other": 0.10}
COUNTRIES = "United States|United Kingdom|South Africa|New Zealand|South Korea|Saudi Arabia|Costa Rica|Sri Lanka|Germany|France|Spain|Italy|Portugal|Austria|Switzerland|Belgium|Netherlands|Ireland|Denmark|Norway|Sweden|Finland|Poland|Greece|Turkey|Russia|Ukraine|China|Japan|India|Brazil|Argentina|Chile|Peru|Mexico|Canada|Australia|Egypt|Kenya|Nigeria|Morocco|Israel|Vietnam|Thailand|Indonesia|Malaysia|Singapore|Philippines|Colombia".split("|")
COUNTRY_CODES = "USA|UK|UAE|US|EU".split("|")
COMPANIES = "Microsoft|Google|Amazon|Apple|Meta|Intel|Oracle|Siemens|Bosch|Volkswagen|Toyota|Honda|Sony|Samsung|Nestle|Unilever|Shell|Total|Airbus|Boeing|Ford|General Motors|Walmart|Target|Costco|Pfizer|Novartis|Roche|Bayer|Adobe|Netflix|Spotify|Uber|Tesla".split("|")
FIRST_NAMES = "James|Mary|John|Patricia|Robert|Jennifer|Michael|Linda|William|Elizabeth|David|Barbara|Richard|Susan|Joseph|Jessica|Thomas|Sarah|Maria|Anna|Peter|Paul|Laura|Julia|Alice|Emma|Omar|Ada|Grace|Linus|Ann|Jane|Hans|Klaus|Pierre|Marie|Jean|Carlos|Ana|Luis".split("|")
LAST_NAMES = "Smith|Johnson|Williams|Brown|Jones|Garcia|Miller|Davis|Lopez|Wilson|Anderson|Taylor|Moore|Jackson|Martin|Lee|Carter|Weber|Schmidt|Meyer|Parker|Diaz|King|Berg|Hopper|Roe|Doe|Fischer|Wagner|Dubois".split("|")


def rows() -> list[tuple[str, str, str, float]]:
    """(term in lower case, kind, entity type, score)."""
    out = [(t.lower(), "city", "LOCATION", min(0.95, round(0.70 + CITY_BOOST[k], 2))) for k, ts in CITIES.items() for t in ts.split("|")]
    out += [(t.lower(), "country", "LOCATION", 0.90) for t in COUNTRIES]
    out += [(t.lower(), "company", "COMPANY", 0.90) for t in COMPANIES]
    out += [(t.lower(), "first_name", "PERSON", 0.60) for t in FIRST_NAMES]
    return out + [(t.lower(), "last_name", "PERSON", 0.60) for t in LAST_NAMES]


def values(kinds: tuple[str, ...]) -> str:
    return "(VALUES " + ", ".join(f"('{t}', '{k}', '{e}', cast({s} as double))" for t, k, e, s in rows() if k in kinds) + ") AS dict(term, kind, entity_type, score)"
