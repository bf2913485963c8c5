"""Code lists and ladders that decide results."""

# Policy status codes by meaning.
STATUS_CODES = {
    "inforce": ("1", "2", "3", "5"),
    "lapse": ("B",),
    "surr": ("E",),
    "mature": ("F", "H", "D", "M", "T"),
    "nottaken": ("A",),
    "ter": ("C", "L", "N", "R", "X"),
    "paid": ("4", "7", "9"),
}
ACTIVE_CODES = ("1", "2", "3", "5", "7")
VOID_CODES = ("A", "N", "R")
NOT_TAKEN_CODES = ("A", "N")
PENDING_CODES = ("6", "8")
LAPSED_CODE = "B"
REJECTED_CODE = "R"
RIDER_CODE = "R"

# Months between premiums, and the names used in reports.
PAYMENT_MODES = {1: "monthly", 3: "quarterly", 6: "half-yearly", 12: "yearly"}

# Beneficiary codes. A code that is not listed has no name.
RELATION_CODES = {
    0: "Others", 1: "Self", 2: "Spouse", 3: "Child", 4: "Others",
    5: "Others", 10: "Others", 31: "Others", 51: "Parent", 52: "Others",
}

# Title letters, the tier ladder in order, and yearly premium needed per tier.
TITLE_NAMES = {"S": "Silver", "G": "Gold", "P": "Platinum"}
TIER_LADDER = ("Unranked", "Silver", "Gold", "Platinum", "MDRT", "COT", "TOT")
TIER_BENCHMARKS = {
    "Silver": 60000.0, "Gold": 360000.0, "Platinum": 600000.0,
    "MDRT": 721626.6, "COT": 2164879.8, "TOT": 4329759.6,
}

# Local currency (thousands) per US dollar, and yearly premium bounds of VIP tiers in dollars.
FX_RATE = 23.145
VIP_BOUNDS = {"elite": 12961.76, "plat": 6480.88, "gold": 2808.38, "silver": 864.12}

# Distribution channel codes by margin family.
CHANNEL_CODES = {
    "banca": (
        "03", "10", "14", "16", "17", "18", "19", "22", "23", "24", "25", "29",
        "30", "31", "32", "33", "39", "41", "44", "47", "49", "51", "52", "53",
    ),
    "affinity": ("48",),
    "agency": ("01", "02", "08", "50", "*"),
    "direct": ("05", "06", "07", "34", "36"),
}
FIXED_MARGIN_CODE = "09"
FIXED_MARGIN = -1.34041044648343

# Claim codes that count as a benefit paid, in the current and in the older list.
CLAIM_CODES = (3, 7, 9, 11, 27, 28, 29, 36, 38, 50, 51)
CLAIM_CODES_OLDER = (3, 7, 8, 11, 27)

# Hit sources that are not page views.
EXCLUDED_HIT_SOURCES = ("5", "7", "8", "9")

# Company codes whose agents are partners and carry no tenure.
PARTNER_CODES = ("04", "05", "34", "36", "97", "98")

# Band edges and labels (right-closed) used by the customer and agent reports.
INF = float("inf")
AGENT_BANDS = {
    "agt_tenure_mths": ([0, 12, INF], ["<=1 year", ">1 year"]),
    "14m_per": ([0, 0.7, 1], ["<=70%", "70%+"]),
    "last_12m_prd": ([-1, 2, INF], ["<=2 product types", ">2 product types"]),
    "last_12m_ape": ([0, 5000, 7000, 10000, INF], ["<=5k", "5-7k", "7-10k", "10k+"]),
    "1yr_agent_activeness": ([0, 0.3, 0.6, 1], ["Low", "Medium", "High"]),
    "cus_existing": ([0, 2, INF], ["<=2 customers", ">2 customers"]),
    "no_sbw_completed": ([-1, 0, INF], ["No trainings completed", "at least 1 training completed"]),
}
SEGMENT_BANDS = {
    "1yr_agent_activeness": ([0, 0.3, 0.6, 0.9, INF], ["9m+", "6-9m", "3-6m", "<3m"]),
    "po_num_count": ([0, 3, 5, 7, 10, INF], ["<=3", "4-5", "5-7", "7-10", "10+"]),
    "all_pol_cnt": ([0, 10, 20, 30, 50, INF], ["<=10", "11-20", "21-30", "31-50", "51+"]),
}
CUSTOMER_BANDS = {
    "total_ape": (
        [0, 1000, 2000, 3000, 5000, 7000, 10000, INF],
        ["1. <=1k", "2. 1-2k", "3. 2-3k", "4. 3-5k", "5. 5-7k", "6. 7-10k", "7. >10k"],
    ),
    "adj_mthly_incm": (
        [500, 1000, 1500, 2000, 3000, 5000, INF],
        ["1. 500-1k", "2. 1-1.5k", "3. 1.5-2k", "4. 2-3k", "5. 3-5k", "6. >5k"],
    ),
    "no_dpnd": ([0, 0.1, 1, 2, INF], ["0", "1", "2", "3+"]),
    "clm_6m_cnt": ([0, 0.1, 1, 2, 4, INF], ["0", "1", "2", "3-4", "5+"]),
    "clm_6m_ratio": ([0, 0.25, 0.5, 0.75, INF], ["<= 25%", "<= 50%", "<=75%", ">75%"]),
    "ins_typ_count": ([0, 1, 2, INF], ["1", "2", "2+"]),
    "rider_cnt": ([0, 1, 2, 3, 5, INF], ["1", "2", "3", "4-5", "5+"]),
    "cur_age": (
        [0, 24, 30, 35, 40, 45, 50, 55, INF],
        ["<25", "25-30", "31-35", "36-40", "41-45", "46-50", "51-55", "55+"],
    ),
    "gap_to_next_tier": (
        [0, 20000, 50000, 75000, 100000, 150000, 200000, 250000, 300000, INF],
        ["<=20m", "20-50m", "50-75m", "75-100m", "100-150m", "150-200m", "200-250m", "250-300m", "300m+"],
    ),
}
PROTECTION_BANDS = {  # kept by the older customer report only
    "protection_income%": ([0, 10.01, 25, 50, INF], ["1. >90%", "2. 75-90%", "4. 50-75%", "5. <50%"]),
}
PROFILE_EDGES = {
    "no_dpnd": [0, 1, 2, 3, INF],
    "cur_age": [0, 25, 35, 55, INF],
    "adj_mthly_incm": [0, 1000, 2000, 3000, INF],
    "client_tenure": [0, 1, 2, 3, 4, 5, INF],
    "inforce_pol": [0, 1, 2, 3, INF],
    "total_ape": [0, 1000, 2000, 3000, INF],
    "rider_cnt": [0, 1, 2, 3, INF],
}

# Activity codes of the agent scorecard, lifestage names, and the kind of the persistency balance.
TOP_LISTS = ("MDRT", "TOT", "COT")
ACTIVITY_FLAGS = {"fc_flag": "FC", "mba_flag": "MBA", "active_1m_flag": "1mAA", "active_3m_flag": "3mAA"}
LIFESTAGE_FLAGS = {
    "f_adult_self_insured": "Adult Self Insured", "f_family": "Family", "f_family_wkids": "Family with Kids",
    "f_empty_nest": "Empty Nester", "f_undefined_segment": "Undefined Segmentation",
}
PERSISTENCY_KIND = "A214"

# Segment names.
MARITAL_LABELS = ("1. Married w/ kids", "2. Married", "3. Unknown")
VIP_LABELS = ("1. Elite Platinum", "2. Platinum", "3. Gold", "4. Silver", "5. Unknown")
FAMILY_LABELS = (
    "1. Family Guardians", "2. Mature Couples", "3. Younger Couples",
    "4. Personal Protection Seekers", "5. Unknown",
)
PERFORMANCE_LABELS = ("Top Performers", "High Performers", "The Slackers")
RECENCY_LABELS = ("1mA", "3mA", "6mA", "9mA", "12mA", "12m-Inactive")
