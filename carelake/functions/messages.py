"""Fixed texts of the clinical and nurse rules.

Fixed values: these strings must equal the reference's output texts (alerts,
validation messages, recommendations, comments).  They are listed together,
in the reference's order; the reference's mis-encoded dashes are written as a
plain ASCII "-".
"""

# Blood-pressure alerts (R1), in band order.
BP_ALERTS = {
    "low": "Blood pressure is below 90/60 mmHg.",
    "severe": "Blood pressure is above 180/120 mmHg.",
    "stage2": "Blood pressure is in the Stage 2 hypertension range.",
    "stage1": "Blood pressure is in the Stage 1 hypertension range.",
    "elevated": "Blood pressure is elevated above normal.",
}

# Glucose alerts (R2), in band order.
GLUCOSE_ALERTS = {
    "severe_low": "Glucose is below 54 mg/dL.",
    "low": "Glucose is below 70 mg/dL.",
    "fasting_prediabetes": "Fasting glucose is in the prediabetes range.",
    "fasting_diabetes": "Fasting glucose is in the diabetes range.",
    "random_elevated": "Random glucose is elevated but not by itself diagnostic for diabetes.",
    "random_diabetes": "Random glucose is in the diabetes range.",
}

# Nurse validation messages (N2), in check order.
NURSE_VALIDATION = {
    "age": "Invalid age (must be 1-120).",
    "bp_missing": "Blood pressure is missing.",
    "systolic": "Invalid systolic BP (must be 50-250).",
    "diastolic": "Invalid diastolic BP (must be 30-150).",
    "glucose_missing": "Glucose is missing.",
    "glucose_low": "Invalid glucose (must be > 0).",
    "glucose_high": "Invalid glucose (value too high).",
    "bmi_missing": "BMI is missing.",
    "bmi": "Invalid BMI (must be 10-60).",
}

# Emergency alerts (N3 symptom triggers, N5 vital triggers).
EMERGENCY_ALERTS = {
    "unconscious": "Critical condition: unconscious.",
    "heart": "Possible heart attack: chest pain + shortness of breath.",
    "load": "Severe symptom load (5+ symptoms).",
    "crisis": "Hypertensive crisis (BP > 180/120).",
    "hypo": "Severe hypoglycemia (glucose < 54 mg/dL).",
    "hyper": "Severe hyperglycemia (glucose > 300 mg/dL).",
}

# Nurse tags.
TAGS = {
    "infection": "Infection suspected",
    "hypertension": "Hypertension-related",
    "diabetes": "Diabetes-related",
    "multi": "Multi-system issue",
}

# Appointment recommendation and priority by triage level.
RECOMMENDATION_VALID = {"Critical": "Immediate (0-10 mins)", "High": "Within 1 hour", "Moderate": "Same day",
                        "other": "Normal booking"}
RECOMMENDATION_INVALID = {"Critical": "Immediate (0-10 mins)", "High": "Within 1 hour (vitals ASAP)",
                          "other": "Vitals required"}
PRIORITY_VALID = {"Critical": "Immediate emergency review recommended", "High": "Urgent consultation",
                  "Moderate": "Priority follow-up", "other": "Normal booking"}
PRIORITY_INVALID = {"Critical": "Immediate attention", "High": "Urgent consultation (symptoms)",
                    "other": "Vitals required"}

# Nurse comments by triage level.
COMMENT_VALID = {
    "Critical": "Escalate immediately and follow emergency protocol.",
    "High": "Fast-track for urgent evaluation and document vitals + key symptoms.",
    "Moderate": "Schedule same-day review; monitor symptoms and recheck vitals if needed.",
    "other": "Proceed with normal workflow; provide standard precautions and follow-up guidance.",
}
COMMENT_INVALID = {
    "Critical": "Escalate immediately and follow emergency protocol.",
    "High": "High-risk symptoms present. Capture vitals urgently and fast-track for review.",
    "other": "Complete vitals entry to enable full triage.",
}

# Nurse suggestions (N8) and notes.
SUGGESTIONS_VALID = {
    "low_glucose": "If confirmed low glucose, provide fast-acting carbohydrate per protocol and recheck.",
    "fever": "Supportive care and temperature monitoring per protocol.",
    "bp": "Recheck BP after rest using correct cuff size and positioning.",
}
SUGGESTIONS_INVALID = [
    "Confirm vitals using correct equipment and technique.",
    "If the patient looks unwell or symptoms are worrying, escalate per clinic protocol.",
]
NOTES = {
    "repeated": "Recurring symptom pattern seen in the reference dataset (pattern match).",
    "chronic": "Reference patterns suggest a possible chronic trend (not a diagnosis).",
}

# Account validation messages (J35), in check order.
ACCOUNT_ERRORS = {
    "phone_length": "Phone number must be exactly 10 digits.",
    "phone_digits": "Phone number must contain digits only (0-9).",
    "email": "Invalid email format.",
    "name_length": "Full name must be 2-100 characters long.",
    "name_chars": "Full name must contain only letters and spaces.",
    "role": "Invalid role selected.",
    "email_taken": "An account with this email already exists.",
    "phone_taken": "An account with this phone number already exists.",
}

# Booking and cancellation outcomes.
BOOKING_ERRORS = {
    "no_patient": "Patient account not found.",
    "doctor_on_leave": "Selected doctor is on leave for that date.",
    "emergency_prefix": " Emergency doctors: ",
    "no_appointment": "Appointment not found.",
    "not_cancellable": "This appointment cannot be cancelled.",
    "past": "Past appointments cannot be cancelled.",
    "cancel_prefix": "Cancelled: ",
}

# Leave check and leave request messages.
LEAVE_MESSAGES = {
    "on_leave": "Doctor is on leave for the selected date.",
    "available": "Doctor is available.",
    "own_calendar": "Doctors can only update their own leave calendar.",
    "end_before_start": "Leave end time must be after start time.",
}
