"""Column rules: text cleaning, titles, places, pay and display."""
