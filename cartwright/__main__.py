from cartwright.jobs import main

main()
