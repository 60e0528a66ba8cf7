"""Functions of the rail and timetable engine."""
