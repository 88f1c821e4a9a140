"""Word lists for names, places, currencies and filler text.

Weights are expressed by repetition nowhere here; every list is uniform.
"""

FIRST_NAMES = """
Aaron Ada Adam Alice Amara Andre Anna Anton Ava Beatrice Ben Bianca Carl Carmen Chloe Clara Daniel Daria David
Diana Edgar Elena Eli Emma Erik Eva Felix Fiona Frank Freya George Gloria Grace Hanna Harold Hugo Ida Igor Ines
Isaac Ivan Jack Jana Jean Jorge Julia Kai Karin Kevin Lara Leo Lily Lucas Maria Mark Maya Nina Noah Olga Oscar
Paula Peter Quinn Rita Robert Rosa Samuel Sara Simon Sofia Thomas Uma Victor Vera Walter Wendy Xavier Yara Zoe
""".split()

LAST_NAMES = """
Abbott Adler Allen Baker Barnes Becker Bell Berg Bishop Brandt Brooks Carter Chavez Clark Cohen Cole Cruz Dahl
Dalton Diaz Dixon Doyle Duarte Edwards Ellis Evans Fischer Fleming Ford Foster Garcia Gibson Graham Grant Gupta
Hansen Harper Hayes Hoffman Holm Hunt Ito Jensen Jordan Kaur Keller Kim King Klein Lang Larsen Lee Lopez Marsh
Martin Meyer Mills Moore Nash Nguyen Nolan Novak Olsen Ortega Owens Park Patel Perez Quist Reed Rossi Sato Shaw
Silva Stone Tanaka Torres Turner Vance Vega Wagner Walsh Weber White Wolf Young Zhang
""".split()

CITIES = [
    "amsterdam", "athens", "auckland", "bangkok", "barcelona", "berlin", "bogota", "boston", "brussels", "budapest",
    "buenos aires", "cairo", "cape town", "chicago", "copenhagen", "dallas", "delhi", "denver", "dublin", "geneva",
    "hamburg", "helsinki", "istanbul", "jakarta", "kyoto", "lagos", "lima", "lisbon", "london", "los angeles",
    "madrid", "manila", "melbourne", "mexico city", "milan", "montreal", "mumbai", "nairobi", "new york", "osaka",
    "oslo", "paris", "prague", "rome", "santiago", "seattle", "seoul", "singapore", "stockholm", "sydney", "tokyo",
    "toronto", "vienna", "warsaw", "zurich",
]

COUNTRIES = [
    "Argentina", "Australia", "Austria", "Belgium", "Brazil", "Canada", "Chile", "China", "Colombia", "Denmark",
    "Egypt", "Estonia", "Finland", "France", "Germany", "Greece", "Hungary", "Iceland", "India", "Indonesia",
    "Ireland", "Israel", "Italy", "Japan", "Kenya", "Latvia", "Lithuania", "Mexico", "Morocco", "Netherlands",
    "New Zealand", "Nigeria", "Norway", "Peru", "Philippines", "Poland", "Portugal", "Romania", "Singapore",
    "South Africa", "South Korea", "Spain", "Sweden", "Switzerland", "Thailand", "Turkey", "Ukraine",
    "United Kingdom", "United States", "Vietnam",
]

STATES = [
    "Alabama", "Alaska", "Arizona", "Arkansas", "California", "Colorado", "Connecticut", "Delaware", "Florida",
    "Georgia", "Hawaii", "Idaho", "Illinois", "Indiana", "Iowa", "Kansas", "Kentucky", "Louisiana", "Maine",
    "Maryland", "Massachusetts", "Michigan", "Minnesota", "Mississippi", "Missouri", "Montana", "Nebraska",
    "Nevada", "New Hampshire", "New Jersey", "New Mexico", "New York", "North Carolina", "North Dakota", "Ohio",
    "Oklahoma", "Oregon", "Pennsylvania", "Rhode Island", "South Carolina", "South Dakota", "Tennessee", "Texas",
    "Utah", "Vermont", "Virginia", "Washington", "West Virginia", "Wisconsin", "Wyoming",
]

STATE_CODES = """
AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA
RI SC SD TN TX UT VT VA WA WV WI WY
""".split()

CURRENCIES = """
AED ARS AUD BGN BHD BRL CAD CHF CLP CNY COP CZK DKK EGP EUR GBP HKD HUF IDR ILS INR ISK JOD JPY KES KRW KWD MAD
MXN MYR NOK NZD OMR PEN PHP PLN QAR RON SAR SEK SGD THB TND TRY TWD UAH USD VND ZAR
""".split()

# ISO 4217 minor units that differ from two digits.
NO_DIGIT_CURRENCIES = "BIF CLP DJF GNF ISK JPY KMF KRW PYG RWF UGX UYI VND VUV XAF XOF XPF".split()
THREE_DIGIT_CURRENCIES = "BHD IQD JOD KWD LYD OMR TND".split()

LOREM = """
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna
aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute
irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non
proident sunt culpa qui officia deserunt mollit anim id est laborum
""".split()

FACTS = [
    "A row that is never read costs nothing to write twice.",
    "Every shuffle was once somebody's innocent join.",
    "The fastest byte is the one a filter left on disk.",
    "A key that is unique in the spec may not be unique in the data.",
    "Half of all timestamps are in the wrong time zone.",
    "An empty partition still takes a task.",
    "A null is neither equal to nor different from another null.",
    "Two thirds of a second is a long time for a processor.",
    "The last chunk is the one nobody tested.",
    "A broadcast that fits today may not fit tomorrow.",
    "Column order is a promise made by the header.",
    "Random numbers that can be repeated are easier to trust.",
    "A retry should leave no footprints.",
    "The longest tail belongs to the hottest key.",
]
