"""Vocabularies and orderings of the record."""

# Stages of an application and their groups.
STAGES = ("applied", "recruiter_screen", "phone_screen", "technical", "onsite", "offer", "rejected", "withdrawn", "accepted", "declined")
TERMINAL = ("rejected", "withdrawn", "accepted", "declined")
OUTCOMES = ("offer", "accepted", "rejected", "withdrawn", "declined")
INTERVIEWS = ("recruiter_screen", "phone_screen", "technical", "onsite")
BEYOND_SCREEN = ("phone_screen", "technical", "onsite", "offer", "accepted")
IN_FLIGHT = ("recruiter_screen", "phone_screen", "technical", "onsite", "offer")

# How far an offer's story has come, least first; and progress through the funnel.
OFFER_RANK = ("applied", "recruiter_screen", "phone_screen", "technical", "onsite", "rejected", "withdrawn", "offer", "declined", "accepted")
PROGRESS = {"applied": 0, "recruiter_screen": 1, "phone_screen": 2, "technical": 3, "onsite": 4, "offer": 5}

# Assumed hours of a round and of the preparation behind it, and of each active month.
ROUND_HOURS = {"recruiter_screen": 0.5, "phone_screen": 0.5, "technical": 1.0, "onsite": 3.0}
PREP_HOURS = {"recruiter_screen": 0.5, "phone_screen": 2.0, "technical": 4.0, "onsite": 8.0}
PREP_MONTH = 8.0

GHOSTED_AFTER = 21
