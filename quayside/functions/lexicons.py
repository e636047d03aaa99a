"""Word lists. Some entries appear twice in a list and count twice."""

from __future__ import annotations


# Frequent Bengali words in Latin letters.
BANGLISH = frozenset([
    "ki", "kii", "koto", "kotota", "kon", "konta", "kothay", "kothai", "keno", "kemon", "kivabe", "kibhabe",
    "kokhon", "ache", "achhe", "asen", "achen", "nai", "nei", "hoise", "hoyeche", "hoyse", "hoyechhe", "hocche",
    "hoche", "hobe", "hoy", "hoini", "chilo", "chhilo", "chila", "korbo", "korte", "kore", "koro", "korsi",
    "korechi", "korchi", "bolo", "bolen", "bolun", "dekhao", "dekhan", "amar", "amader", "apnar", "apnader", "tomar",
    "tomader", "tar", "tader", "eta", "ota", "ekta", "ei", "oi", "shei", "sei", "gula", "gulo", "guli", "ta", "ti",
    "er", "ke", "theke", "pore", "age", "mash", "masher", "bochor", "bochore", "bochorer", "din", "diner", "shob",
    "sob", "shobcheye", "sobcheye", "shobche", "beshi", "kom", "bikri", "taka", "tk", "dam", "ekhon", "jonno",
    "niye", "abar", "kintu", "ar", "ba", "na", "haan", "hya", "ji", "bhai", "vai", "apu", "ektu", "onek", "kichu",
    "kotojon", "kotogula", "sathe", "diye", "pawa", "pabo", "pai", "jay", "jai", "lagbe", "lage", "parbo", "parben",
    "dorkar", "chai", "chaai", "janao", "jante", "janben", "kinse", "kinechhe", "kinlo", "kinbo", "bechi", "becha",
    "ferot", "shubidha", "niyom", "niti", "chuti", "mot", "gorbo",
])

# Words a keyword query leaves out.
STOP_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "what", "which", "who", "how", "our", "your", "for", "and", "or",
    "of", "to", "in", "on", "at", "do", "does", "can", "i", "we", "me", "about", "with", "this", "that", "it", "be",
    "tell", "please", "according", "say", "says", "কী", "কি", "কত", "এর", "এই", "আমাদের", "আমার", "হয়", "করে", "ki",
    "koto", "er", "amader",
]

# Vocabulary of each business table.
TABLE_TERMS = {
    "orders": [
        "order", "orders", "sale", "sales", "revenue", "income", "turnover", "purchase", "purchased", "bought",
        "channel", "aov", "average order", "spent", "spend", "অর্ডার", "বিক্রি", "বিক্রয়", "আয়", "রেভিনিউ", "কেনা",
        "খরচ", "bikri", "bikroy", "kena", "kinse", "kinechhe", "khoroch", "cancelled", "canceled", "বাতিল", "order",
        "sell", "sales",
    ],
    "order_items": [
        "sold", "selling", "best-selling", "best selling", "top-selling", "units", "quantity", "most sold", "sell",
        "item", "items", "বিক্রি", "বেশি বিক্রি", "পরিমাণ", "beshi sell", "beshi bikri", "sell hoise",
        "sell hoyeche",
    ],
    "products": [
        "product", "products", "item", "sku", "brand", "price", "priced", "warranty", "catalog", "catalogue",
        "discontinued", "margin", "cost", "পণ্য", "প্রোডাক্ট", "দাম", "ব্র্যান্ড", "ওয়ারেন্টি", "ponno", "dam",
        "dam koto",
    ],
    "categories": [
        "category", "categories", "segment", "ক্যাটাগরি", "বিভাগ", "ধরন", "catagory",
    ],
    "customers": [
        "customer", "customers", "client", "clients", "buyer", "buyers", "member", "members", "membership", "tier",
        "gold", "platinum", "silver", "bronze", "country", "city", "highest-value", "high-value", "loyal", "গ্রাহক",
        "কাস্টমার", "ক্রেতা", "সদস্য", "বাংলাদেশে", "দেশ", "শহর", "grahok", "kastomar", "customer",
    ],
    "payments": [
        "payment", "payments", "paid", "bkash", "nagad", "card", "cash on delivery", "cod", "transaction",
        "bank transfer", "failed payment", "পেমেন্ট", "বিকাশ", "নগদ", "লেনদেন", "payment method",
    ],
    "inventory": [
        "stock", "inventory", "warehouse", "reorder", "in stock", "out of stock", "available", "on hand", "restock",
        "মজুদ", "স্টক", "গুদাম", "stock koto", "stock ache",
    ],
    "returns": [
        "return", "returns", "returned", "refund", "refunds", "refunded", "defective", "damaged", "return rate",
        "ফেরত", "রিটার্ন", "রিফান্ড", "ferot", "return hoise",
    ],
    "reviews": [
        "review", "reviews", "rating", "ratings", "stars", "feedback", "rated", "রিভিউ", "রেটিং", "মতামত",
    ],
}

# Counts, totals, rankings, periods.
ANALYTICS_TERMS = [
    "how many", "total", "count", "number of", "average", "avg", "sum", "top", "highest", "lowest", "most", "least",
    "rank", "trend", "per month", "monthly", "last month", "this month", "last year", "this year", "last quarter",
    "last week", "last 30 days", "compare", "growth", "percentage of", "list", "show me", "who are", "মোট", "কতগুলো",
    "কতজন", "সবচেয়ে", "সর্বোচ্চ", "সর্বনিম্ন", "গড়", "গত", "তালিকা", "দেখাও", "kotogula", "koto gula", "koto jon",
    "kotojon", "shobcheye", "sobcheye", "beshi", "gorbo", "goto mash", "last mash", "last month e", "dekhao",
]

# Policies, rules, entitlements.
DOCUMENT_TERMS = [
    "policy", "policies", "handbook", "guideline", "guidelines", "rule", "rules", "procedure",
    "terms and conditions", "eligible", "eligibility", "entitled", "benefit", "benefits", "faq", "document",
    "according to", "allowed", "not allowed", "cannot", "can't", "leave", "warranty", "shipping", "delivery",
    "refund period", "return window", "how do i", "how to", "how long", "do i", "can i", "need to", "what does our",
    "what does the policy", "what is our", "what are our", "employee", "employees", "holiday", "working hours",
    "dress code", "cost", "fee", "charge", "minimum", "maximum", "limit", "requirement", "requirements", "bonus",
    "discount", "receive", "covered", "cover", "store credit", "নীতি", "নিয়ম", "পলিসি", "নির্দেশিকা", "ছুটি",
    "সুবিধা", "শর্ত", "প্রক্রিয়া", "হ্যান্ডবুক", "ডকুমেন্ট", "অনুযায়ী", "কর্মচারী", "ডেলিভারি", "চার্জ", "ছাড়",
    "শতাংশ", "সীমা", "কত দিন", "niti", "niyom", "policy ki", "chuti", "shubidha", "kivabe", "ki vabe", "lage",
    "pete", "pabo", "koto din", "korte hoy", "charge koto",
]

# The user's own company; its name is a parameter where the list is used.
COMPANY_TERMS = [
    "our", "we", "us", "company", "store", "shop", "আমাদের", "আমরা", "কোম্পানি", "কোম্পানির", "amader", "amra",
    "company",
]

# General knowledge and small talk.
GENERAL_TERMS = [
    "what is a", "what is an", "what are", "explain", "define", "definition", "meaning of", "how does",
    "difference between", "why is", "hello", "hi", "hey", "thanks", "thank you", "good morning", "who are you",
    "write a", "translate", "মানে কী", "ব্যাখ্যা", "কী", "হ্যালো", "ধন্যবাদ", "কাকে বলে", "mane ki", "bujhao",
    "bojhao", "dhonnobad", "hello",
]

# Words that join two questions.
CONJUNCTIONS = [" and ", " also ", " plus ", " এবং ", " আর ", " ও ", " ebong ", " ar ", " sathe "]

# Pronouns that point back to the previous question.
FOLLOW_UPS = [
    "them", "those", "these", "it", "its", "that", "they", "their", "same", "ওগুলো", "সেগুলো", "এগুলো", "এটার",
    "ওটার", "egula", "ogula", "ogulo", "egulo", "ota", "eta", "tader",
]

# Names of the language codes.
LANGUAGE_LABELS = {"en": "English", "bn": "Bengali", "banglish": "Banglish", "mixed": "Bengali + English"}

# Tables taken when a question names none.
DEFAULT_TABLES = ["orders", "order_items", "products", "customers"]

# Fixed replies for missing evidence, by case and language.
REPLIES = {
    "no_documents": {
        "en": "I couldn't find this information in the available documents.",
        "bn": "দুঃখিত, উপলব্ধ ডকুমেন্টগুলোতে এই তথ্যটি খুঁজে পাইনি।",
        "banglish": "Sorry, available documents e ei tottho khuje pai ni.",
    },
    "no_data": {
        "en": "The database does not contain enough information to answer this question.",
        "bn": "ডাটাবেসে এই প্রশ্নের উত্তর দেওয়ার মতো যথেষ্ট তথ্য নেই।",
        "banglish": "Database e ei proshner uttor dewar moto jotheshto tottho nei.",
    },
    "sql_failed": {
        "en": "I couldn't build a safe, valid database query for this question. Please try rephrasing it with more detail.",
        "bn": "এই প্রশ্নের জন্য একটি নিরাপদ ও সঠিক ডাটাবেস কোয়েরি তৈরি করতে পারিনি। অনুগ্রহ করে প্রশ্নটি আরেকটু বিস্তারিতভাবে লিখুন।",
        "banglish": "Ei proshner jonno safe database query banate parini. Ektu details diye abar jiggesh korun.",
    },
    "nothing_found": {
        "en": "I couldn't find this information in the database or in the available documents.",
        "bn": "ডাটাবেস বা উপলব্ধ ডকুমেন্ট—কোথাও এই তথ্যটি খুঁজে পাইনি।",
        "banglish": "Database ba documents kothao ei tottho khuje pai ni.",
    },
}
