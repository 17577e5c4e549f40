"""Code lists and labels that results depend on."""

# Letter grades, and the lists that leave the grade average and the credit count.
GRADES = ["A", "AU", "B", "C", "CR", "D", "F", "I", "NC", "RD", "RP", "W", "WE", "WU"]
NOT_IN_GPA = ["AU", "CR", "NC", "RD", "RP", "W", "WE"]
NOT_FOR_CREDIT = ["AU", "NC", "RD", "RP", "W", "WE"]
DFW_GRADES = ["D", "F", "I", "NC", "W", "WE", "WU"]
# Grades counted per term (all but RD).
COUNTED_GRADES = ["A", "AU", "B", "C", "CR", "D", "F", "I", "NC", "RP", "W", "WE", "WU"]

# Income band codes.
INCOME_BANDS = {
    1: "LESS THEN $6000",
    2: "$6,000 TO $11,999",
    3: "$12,000 TO $23,999",
    4: "$24,000 TO $35,999",
    5: "$36,000 TO $47,999",
    6: "$48,000 TO $59,999",
    7: "$60,000 OR MORE",
    8: "CANNOT ESTIMATE",
    9: "NO RESPONSE",
}

# Years for which an exact-time response column is made.
GRADUATION_YEARS = [2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 5.5, 6.0]

# Categories of the demographic encodings, as (source column, prefix, labels).
DEMOGRAPHIC_ENCODING = [
    ("gender", "GENDR", ["M"]),
    (
        "ethnicity",
        "",
        [
            "AFRICAN AMERICAN",
            "ASIAN AMERICAN",
            "CAUCASIAN",
            "LATINO/LATINA",
            "NATIVE AMERICAN",
            "PACIFIC ISLANDER",
            "TWO OR MORE RACES, INCLUDING MINORITY",
            "TWO OR MORE RACES, NON-MINORITIES",
            "ETHNICITY UNKNOWN",
            "VISA NON U.S.",
        ],
    ),
    (
        "first_generation",
        "",
        ["CONTINUING GENERATION STUDENT", "FIRST GENERATION STUDENT", "FIRST GENERATION UNKNOWN"],
    ),
    (
        "dep_family_size",
        "DEP_FAM",
        ["1", "10", "12", "15", "2", "25", "3", "4", "5", "6", "7", "8", "9", "NA"],
    ),
    ("minority", "URM", ["MINORITY", "NON-MINORITY"]),
    ("applicant_family_size", "APP_FAM", ["1", "2", "3", "6", "NA"]),
    (
        "applicant_income",
        "INCM",
        ["$12,000 TO $23,999", "$6,000 TO $11,999", "$60,000 OR MORE", "LESS THEN $6000"],
    ),
    ("pell_eligibility", "PELL", ["NON TRADITIONAL", "TRADITIONAL"]),
]
