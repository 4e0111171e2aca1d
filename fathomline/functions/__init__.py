"""Column functions: text, personal data, rules and intents."""
