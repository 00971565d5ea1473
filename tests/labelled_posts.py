"""Labelled posts of the benchmark: fixed values."""

BENCHMARK_POSTS = {
    "clean": [
        "Hello, how are you today?",
        "I love this beautiful weather we're having.",
        "Thank you for your help with the project.",
        "The new restaurant downtown is amazing!",
        "I'm looking forward to the weekend.",
    ],
    "spam": [
        "CLICK HERE TO WIN $1000 NOW!!!",
        "Make money fast from home - guaranteed results!",
        "FREE VIAGRA - LIMITED TIME OFFER!!!",
        "You've won a prize! Claim it now!",
        "Double your money in 24 hours - guaranteed!",
    ],
    "fraud": [
        "I need your bank account details to transfer inheritance money",
        "I'm a Nigerian prince and need your help with $10 million",
        "Your account has been compromised, please verify your details",
        "You've won the lottery! Send $500 processing fee to claim",
        "I can help you get rich quick with this investment opportunity",
    ],
    "profane": [
        "You're a complete idiot and I hate you",
        "This is the worst piece of garbage I've ever seen",
        "Go to hell and never come back",
        "I hope you die in a fire",
        "You're so stupid it's unbelievable",
    ],
    "nuanced": [
        "The stock market crash could be seen as both a disaster and opportunity",
        "While the policy has good intentions, it may have unintended consequences",
        "The debate about climate change involves complex scientific and economic factors",
        "This decision affects multiple stakeholders with competing interests",
        "The situation requires careful consideration of ethical implications",
    ],
}
