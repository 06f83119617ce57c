"""Searches that a resolver must answer in one known way, to be recorded once and replayed after every change."""

from __future__ import annotations

# fixed values: title as exported, year, film_id of the right answer (None: there is none), match method
SEARCHES: tuple[tuple[str, int, int | None, str], ...] = (
    ("Whiplash", 2013, 367412, "exact"),
    ("Whiplash", 2014, 244786, "exact"),
    ("Nosferatu", 1922, 653, "exact"),
    ("Nosferatu", 2024, 426063, "exact"),
    ("Joker", 2012, 129507, "exact"),
    ("Joker", 2019, 475557, "exact"),
    ("Aladdin", 2019, 420817, "exact"),
    ("Frozen", 2013, 109445, "exact"),
    ("Beauty and the Beast", 1991, 10020, "exact"),
    ("Les Misérables", 1998, 4415, "exact"),
    ("Les Misérables", 2012, 82695, "exact"),
    ("Aladdin", 1992, 812, "dominant"),
    ("Frozen", 2010, 44363, "dominant"),
    ("Beauty and the Beast", 2017, 321612, "dominant"),
    ("Mission: Impossible – Rogue Nation", 2015, 177677, "exact"),
    ("Mission: Impossible – Ghost Protocol", 2011, 56292, "exact"),
    ("Mission: Impossible – Fallout", 2018, 353081, "exact"),
    ("Mission: Impossible – The Final Reckoning", 2025, 575265, "exact"),
    ("John Wick: Chapter 3 – Parabellum", 2019, 458156, "exact"),
    ("Gangs of Wasseypur – Part 1", 2012, 117691, "exact"),
    ("Gangs of Wasseypur – Part 2", 2012, 126400, "exact"),
    ("Golmaal – Fun Unlimited", 2006, 19670, "exact"),
    ("Star Wars: Episode I – The Phantom Menace", 1999, 1893, "exact"),
    ("Star Wars: Episode II –\u00a0Attack of the Clones", 2002, 1894, "exact"),
    ("Star Wars: Episode III –\u00a0Revenge of the Sith", 2005, 1895, "exact"),
    ("Léon: The Professional", 1994, 101, "exact"),
    ("The Double Life of Véronique", 1991, 1600, "exact"),
    ("Bāhubali: The Beginning", 2015, 256040, "exact"),
    ("Bāhubali 2: The Conclusion", 2017, 350312, "exact"),
    ("Üç Harfliler: Fal", 2025, 1432726, "exact"),
    ("Alien³", 1992, 8077, "exact"),
    ("WALL·E", 2008, 10681, "exact"),
    ("Salò, or the 120 Days of Sodom", 1975, 5336, "trigram"),
    ("Mission: Impossible – Dead Reckoning", 2023, 575264, "trigram"),
    ("The Godfather", 1972, 238, "exact"),
    ("Obi-Wan Kenobi", 2022, None, "unresolved"),
)
#: films whose payloads are recorded beside the searches
FILMS = (238, 244786, 310131, 503919)
