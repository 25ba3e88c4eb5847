"""Word lists and tables of the matching rules."""

# They must equal the rules' own for equal results.
LEGAL = "co company corp corporation enterprise enterprises group holdings inc incorporated limited llc llp ltd pllc private pvt sa sarl sas service services solution solutions technologies technology".split()
INDUSTRY = LEGAL + "agencies agency builders center centre construction constructions consultancy consultants consulting developers industries industry infra infrastructure jewellers jewellery logistics motors pharma pharmaceuticals properties realty retail textiles trading".split()
STOP_SHORT = "and apartment apartments at ave avenue bd behind bldg block boulevard building chemin colony dr drive floor highway hwy in lane nagar near of on opp opposite place plot rd road rue sector st street the way".split()
STOP_LONG = STOP_SHORT + "cross dist district flat main null office post room shop taluk tehsil unit".split()
INDIA_STATES = ["andhra pradesh", "arunachal pradesh", "assam", "bihar", "chandigarh", "chhattisgarh", "delhi", "goa", "gujarat", "haryana", "himachal pradesh", "jharkhand", "karnataka", "kerala", "madhya pradesh", "maharashtra", "manipur", "meghalaya", "mizoram", "nagaland", "odisha", "orissa", "punjab", "rajasthan", "sikkim", "tamil nadu", "telangana", "tripura", "uttar pradesh", "uttarakhand", "west bengal"]
INDIA_ABBR = {"ap": "andhra pradesh", "ar": "arunachal pradesh", "as": "assam", "br": "bihar", "ch": "chandigarh", "cg": "chhattisgarh", "dl": "delhi", "ga": "goa", "gj": "gujarat", "hr": "haryana", "hp": "himachal pradesh", "jh": "jharkhand", "ka": "karnataka", "kl": "kerala", "mp": "madhya pradesh", "mh": "maharashtra", "mn": "manipur", "ml": "meghalaya", "mz": "mizoram", "nl": "nagaland", "od": "odisha", "or": "odisha", "pb": "punjab", "rj": "rajasthan", "sk": "sikkim", "tn": "tamil nadu", "ts": "telangana", "tg": "telangana", "tr": "tripura", "up": "uttar pradesh", "uk": "uttarakhand", "ua": "uttarakhand", "wb": "west bengal"}
US_STATES = "ak al ar az ca co ct de fl ga hi ia id il in ks ky la ma md me mi mn mo ms mt nc nd ne nh nj nm nv ny oh ok or pa ri sc sd tn tx ut va vt wa wi wv wy".split()
US_AMBIGUOUS = "ct in la me oh or".split()
METROS = {"ahmedabad": "ahmedabad", "bangalore": "bangalore", "bengaluru": "bangalore", "chennai": "chennai", "madras": "chennai", "delhi": "delhi", "new delhi": "delhi", "hyderabad": "hyderabad", "secunderabad": "hyderabad", "kolkata": "kolkata", "calcutta": "kolkata", "mumbai": "mumbai", "bombay": "mumbai", "pune": "pune"}
# The Latin letter of an offset within each Indic block of 128 characters.
BRAHMIC = {0x05: "a", 0x06: "a", 0x07: "i", 0x08: "i", 0x09: "u", 0x0A: "u", 0x0F: "e", 0x13: "o", 0x14: "o", 0x15: "k", 0x16: "k", 0x17: "g", 0x18: "g", 0x19: "n", 0x1A: "c", 0x1B: "c", 0x1C: "j", 0x1D: "j", 0x1E: "n", 0x1F: "t", 0x20: "t", 0x21: "d", 0x22: "d", 0x23: "n", 0x24: "t", 0x25: "t", 0x26: "d", 0x27: "d", 0x28: "n", 0x2A: "p", 0x2B: "p", 0x2C: "b", 0x2D: "b", 0x2E: "m", 0x2F: "y", 0x30: "r", 0x32: "l", 0x35: "v", 0x36: "s", 0x37: "s", 0x38: "s", 0x39: "h", 0x3E: "a", 0x3F: "i", 0x40: "i", 0x41: "u", 0x42: "u", 0x47: "e", 0x4B: "o", 0x4C: "o"}
ACCENTS = {"a": "àáâãäå", "c": "ç", "e": "èéêë", "i": "ìíîï", "n": "ñ", "o": "òóôõö", "u": "ùúûü", "y": "ýÿ"}
DOMAINS = [".com", ".org", ".net", ".in", ".co", ".fr", "www."]
SOUNDEX = {"1": "bfpv", "2": "cgjkqsxz", "3": "dt", "4": "l", "5": "mn", "6": "r"}
