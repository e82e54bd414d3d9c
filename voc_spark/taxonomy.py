"""Domains, labelled examples and message formats shared by every job."""

# --- Fixed values: label domains -------------------------------------------
FEEDBACK_CATEGORIES = [
    "Product Quality/Defect",
    "Not As Described",
    "Shipping/Delivery Issue",
    "Pricing/Value Complaint",
    "Usability/Performance Issue",
    "Customer Service Experience",
    "Praise/Positive",
    "Insufficient Context",
]
SENTIMENTS = ["Positive", "Neutral", "Negative"]
URGENCIES = ["High", "Medium", "Low"]
URGENCY_AXIS = ["Low", "Medium", "High"]
PRODUCT_CATEGORIES = [
    "Amazon_Fashion",
    "Electronics",
    "Home_and_Kitchen",
    "Beauty_and_Personal_Care",
    "Sports_and_Outdoors",
]
CHART_TYPES = ["bar", "line", "pie"]
QUERY_TYPES = ["count", "lookup", "breakdown", "summary", "chart", "unsupported"]

# The first six categories are complaints, in tie-break order.
COMPLAINTS = FEEDBACK_CATEGORIES[:6]
PRAISE = "Praise/Positive"
NO_CONTEXT = "Insufficient Context"

FILTER_DIMENSIONS = ["product_category", "feedback_category", "sentiment", "urgency"]
GROUP_COLUMNS = FILTER_DIMENSIONS + ["quarter", "verified_purchase"]

# --- Fixed values: sampling defaults ---------------------------------------
WINDOW_START = "2022-01-01"
WINDOW_END = "2022-06-30"
Q1_END = "2022-03-31"
Q1_LABEL = "Q1 2022"
Q2_LABEL = "Q2 2022"
LOW_SHARE = 0.35
MID_SHARE = 0.15

# --- Fixed values: messages and formats ------------------------------------
UNKNOWN_PRODUCT = "Unknown Product"
FALLBACK = {
    "feedback_category": "Insufficient Context",
    "sentiment": "Neutral",
    "urgency": "Low",
    "reasoning": "Automated classification failed due to a system error after retries. "
    "This review has NOT been reviewed for content and should be re-processed.",
}
SUMMARY_UNAVAILABLE = (
    "Unable to generate summary this week due to a system error. "
    "Raw statistics are available in the dashboard charts above."
)
FALLBACK_FOLLOWUPS = [
    "How does this compare to the previous period?",
    "Which product category has the most urgent issues?",
    "What's the sentiment breakdown for negative reviews?",
]
LINE_NOTE = (
    "A line chart isn't meaningful for a categorical breakdown like this, "
    "so it's rendered as a bar chart instead."
)
NO_MATCH = "No data found matching those filters."
NO_REVIEWS_IN_RANGE = "No reviews found in this specific range."
OUT_OF_RANGE_FORMAT = "No data available in that range. Currently available: %s to %s."
NOT_FOUND_FORMAT = "No review found with ID '%s'."
BAD_BREAKDOWN_FORMAT = "'%s' isn't a valid column to break down by."
BAD_CHART_FORMAT = "'%s' isn't a valid column to chart by."
BANNER_FORMAT = "Showing %d reviews matching current filters"
BAD_DATES_FORMAT = "'%s' to '%s' is not a pair of dates (YYYY-MM-DD)."
UNREADABLE_QUESTION = "Unable to process this question due to a system error."
SUMMARY_LABEL_FORMAT = "Custom: %s to %s"
REVIEW_PROMPT_FORMAT = 'Review to classify:\n"""%s"""'
TOOL_NAME = "classify_feedback"
TOOL_REPLY = "Recorded."

# --- Fixed values: column notes of the schema profile ----------------------
# (name, type, range, note); "data" stands for the live date coverage.
PROFILE_COLUMNS = [
    ("review_id", "identifier", None,
     "Unique ID for a specific review. Use for direct lookup of one review, not for filtering/counting."),
    ("product_category", "categorical", None, None),
    ("feedback_category", "categorical", None, None),
    ("sentiment", "categorical", None, None),
    ("urgency", "categorical", None, None),
    ("quarter", "categorical", None, None),
    ("rating", "numeric", "1.0 to 5.0", None),
    ("review_date", "date", "data", "Use for specific date-range questions, not just quarter labels."),
    ("verified_purchase", "boolean", None,
     "Whether Amazon verified the reviewer actually purchased the product."),
]

# --- Fixed values: labelled examples ---------------------------------------
# (review, feedback_category, sentiment, urgency, reasoning)
LABELLED_EXAMPLES = [
    (
        "This computer lasted about 1 day before it couldn't recognize a hard drive available. Somehow, it got damaged during shipping (which took almost 2 weeks)",
        "Product Quality/Defect", "Negative", "High",
        "Primary complaint is the hardware failure (hard drive not recognized) rather than the shipping delay; the product is unusable.",
    ),
    (
        "I didn't know what size it was going to be and I still don't know what size it is. Even after opening. The writing is in a different language and when I tried it on, it is for someone who is very very small",
        "Not As Described", "Negative", "Medium",
        "Complaint centers on sizing/labeling mismatch versus what was expected, not a defect in the item itself.",
    ),
    (
        "Very poor quality",
        "Product Quality/Defect", "Negative", "Medium",
        "Short but explicitly names quality as the problem; confidently classified despite brevity since the subject is specified.",
    ),
    (
        "sad",
        "Insufficient Context", "Negative", "Low",
        "Expresses negative sentiment but doesn't specify what about the product or purchase caused it — could relate to quality, fit, price, or something unrelated entirely.",
    ),
    (
        "I was sort of disappointed with how short this chair was. Felt like I was really close to the ground",
        "Usability/Performance Issue", "Negative", "Low",
        "Product functions but underperforms expectations (too short); not a defect, product isn't broken.",
    ),
    (
        "Not sharp enough to cut smoothly. These are extremely dull and will wreck your nails. It's a complete waste of money, but luckily Amazon refunded me.",
        "Product Quality/Defect", "Negative", "Medium",
        "Primary complaint is the product's poor quality (dull, ineffective); the refund mention is incidental, not the focus.",
    ),
    (
        "Love this jacket! It's a bit more than a jacket, because of the fleece. It fits very well, has a nice design and is very warm.",
        "Praise/Positive", "Positive", "Low",
        "Genuinely satisfied review with no significant complaint.",
    ),
]

# Our own wording of the classification rubric; pass another text where needed.
SYSTEM_PROMPT = """Label one customer review of an online purchase by calling the classify_feedback tool.
Give feedback_category, sentiment, urgency and a one-sentence reasoning that quotes what decided the label.
Choose the category of the main complaint and mention a second one only in the reasoning.
Product Quality/Defect covers broken, faulty or poorly made goods; Not As Described covers a wrong size, colour or listing;
Shipping/Delivery Issue covers the delivery itself; Pricing/Value Complaint covers goods not worth their price;
Usability/Performance Issue covers working goods that are awkward or weak; Customer Service Experience covers seller contact;
Praise/Positive covers satisfied buyers. A feeling without any named aspect is Insufficient Context with Low urgency.
Sentiment follows the overall tone. Urgency is High for safety, unusable goods or a lost customer,
Medium for a plain complaint, and Low otherwise."""
