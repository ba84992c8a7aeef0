"""Part of tabloom."""
